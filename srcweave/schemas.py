"""Schemas of the tables (as DDL), and the words their columns may hold."""

from __future__ import annotations

# Fixed values ---------------------------------------------------------------
COMPONENT_TYPES = (
    "file", "class", "function", "interface", "type-alias", "enum", "module", "decorator",
)
RELATIONSHIP_TYPES = (
    "imports", "exports", "extends", "implements", "calls", "uses-type", "contains", "depends-on",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
GRADES = ("A", "B", "C", "D", "F")
# ---------------------------------------------------------------------------


SOURCE_FILES = (
    "project_id string, file_path string, dir string, base_name string, ext string,"
    " language string, content string, n_lines int"
)

PARAM = "struct<name:string,type:string,is_optional:boolean>"
METHOD_FACT = (
    f"struct<name:string,params:array<{PARAM}>,return_type:string,"
    "decorators:array<string>,is_async:boolean,modifiers:array<string>>"
)
PROPERTY_FACT = "struct<name:string,type:string,modifiers:array<string>>"
#: A top-level declaration.
DECL = (
    "struct<kind:string,name:string,ord:int,start_line:int,end_line:int,block_line:int,"
    f"snippet:string,decorators:array<string>,bases:array<string>,ifaces:array<string>,"
    f"params:array<{PARAM}>,return_type:string,is_exported:boolean,is_default:boolean,"
    f"methods:array<{METHOD_FACT}>,properties:array<{PROPERTY_FACT}>>"
)
IMPORT = (
    "struct<module:string,level:int,names:array<string>,default_name:string,line:int,ord:int>"
)
#: An argument: its text, kind and the sub-expressions taint may come from.
ARG = "struct<text:string,kind:string,names:array<string>,atoms:array<string>>"
CALL = (
    "struct<ord:int,scope_id:string,caller:string,caller_kind:string,callee:string,"
    f"callee_name:string,is_member:boolean,args:array<{ARG}>,kwargs:map<string,string>,"
    "line:int,end_line:int,text:string>"
)
#: A use of a value inside an assigned expression; ``via`` labels the taint path.
USE = "struct<text:string,name:string,via:array<string>>"
ASSIGN = (
    "struct<ord:int,target:string,targets:array<string>,target_kind:string,value:string,"
    f"value_kind:string,call_name:string,is_augmented:boolean,is_decl:boolean,"
    f"uses:array<{USE}>,names:array<string>,line:int,end_line:int>"
)
#: A function body: which of the file's assignments and calls lie in it, also in functions inside it.  They follow
#: each other in document order, so two intervals say it and nothing is stored twice.
SCOPE = (
    "struct<scope_id:string,name:string,line:int,end_line:int,"
    "first_step:int,n_steps:int,first_call:int,n_calls:int>"
)
#: Non-call expressions a rule looks at (templates, concatenations, markup writes).
EXPR = (
    "struct<ord:int,kind:string,text:string,scope_id:string,parent_callee:string,"
    "assigned_to:string,decl_target:string,atoms:array<string>,prop:string,line:int,end_line:int>"
)

#: One row per source file, everything a later step needs nested in it.
PARSED = (
    "project_id string, file_path string, language string, n_lines int, error string,"
    f" decls array<{DECL}>, imports array<{IMPORT}>, calls array<{CALL}>,"
    f" assigns array<{ASSIGN}>, scopes array<{SCOPE}>, exprs array<{EXPR}>, marks array<int>"
)

METADATA = (
    "struct<loc:int,is_exported:boolean,is_default:boolean,decorators:array<string>,"
    f"parameters:array<{PARAM}>,return_type:string,"
    "properties:array<struct<name:string,type:string,visibility:string,is_static:boolean,"
    "is_readonly:boolean>>,"
    f"methods:array<struct<name:string,parameters:array<{PARAM}>,return_type:string,"
    "visibility:string,is_static:boolean,is_async:boolean>>,"
    "extends:string,implements:array<string>>"
)
COMPONENTS = (
    "project_id string, id string, key string, name string, type string, file_path string,"
    f" start_line int, end_line int, ord int, metadata {METADATA}"
)
RELATIONSHIPS = (
    "project_id string, id string, source string, target string, type string,"
    " import_specifiers array<string>, source_key string, target_key string"
)
TAINT_ENTRY = "struct<var:string,source:string,path:array<string>>"
FINDINGS = (
    "project_id string, id string, hit_no int, rule_id string, severity string, title string,"
    " description string, file_path string, start_line int, end_line int, snippet string,"
    " recommendation string, cwe_id string, owasp_category string"
)
RULES = (
    "rule_id string, name string, description string, severity string, cwe_id string,"
    " owasp_category string"
)
RULE_CONFIG = "rule_id string, enabled boolean, severity string"
CONFIG_FILE = (
    "minSeverity string, customSources array<string>, customSinks map<string,array<string>>,"
    " customRouterNames array<string>, trustedMiddleware array<string>,"
    " falsePositivePatterns array<string>,"
    " rules map<string,struct<enabled:boolean,severity:string>>"
)
