"""Tokens of files to units, a batch of files at a time, as numpy arrays.

Spark deals the files to tasks; inside a task the running sums over a file are sums over the flat token list of a batch.
What a token says is worked out once for each distinct token of the batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Tokens placed at once, or those of one file if it has more.
_BATCH_TOKENS = 200_000

_TOKEN_FIELDS = (
    "i:int,t:string,kind:string,pos:bigint,fin:bigint,line:int,end_line:int,gap:boolean,chain:bigint,chain_line:int,before_chain:string"
)
UNIT = (
    f"project_id string, file_path string, depth int, unit bigint, toks array<struct<{_TOKEN_FIELDS}>>, inside bigint, around string,"
    " begin bigint, fin bigint, line int, end_line int, flat string"
)


def kind_of(t: str) -> str:
    """c comment, b blank, s string, t template, r regular expression, d decorator, g type arguments, w word, n number, p mark."""
    first, many = t[0], len(t) > 1
    if t.startswith(("//", "/*")):
        return "c"
    if first in " \t\n\x0b\f\r":
        return "b"
    if many and first in "'\"`@":
        return {"`": "t", "@": "d"}.get(first, "s")
    if many and (first == "/" and t != "/=" or first == "<" and t != "<="):
        return {"/": "r", "<": "g"}[first]
    if first.isascii() and (first.isalpha() or first in "_$#"):
        return "w"
    return "n" if first in "0123456789" else "p"


def flat_piece(t: str, kind: str) -> str:
    """The token as it stands in a unit's flat text."""
    if kind == "s":
        return t[0] * 2
    if kind == "t":
        return "`$`" if "${" in t else "``"
    if kind == "d":
        found = re.match(r"@[\w$.]+", t, re.ASCII)
        return found[0] if found else ""
    return "//" if kind == "r" else t


class _Words:
    """Facts of the distinct tokens of a batch, taken by the codes of its tokens; code -1 is no token."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.kinds = [kind_of(t) for t in tokens]
        self.size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in tokens], np.int64)
        self.lines = np.array([t.count("\n") for t in tokens], np.int64)
        self.pieces = [flat_piece(t, k) for t, k in zip(tokens, self.kinds)]

    def isin(self, codes: np.ndarray, *tokens: str) -> np.ndarray:
        wanted = set(tokens)
        return np.array([*(t in wanted for t in self.tokens), False])[codes]

    def of_kind(self, codes: np.ndarray, kinds: str) -> np.ndarray:
        return np.array([*(k in kinds for k in self.kinds), False])[codes]


def _before(values: np.ndarray, first: np.ndarray, steps: int = 1, none: int = -1) -> np.ndarray:
    """The value so many rows earlier; ``none`` before the first row of a group (``first``: its place, by row)."""
    at = np.arange(len(values)) - steps
    return np.where(at >= first, values[np.maximum(at, 0)], none)


def _latest(test: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The place of the last row of the group, up to this one, where the test holds, or -1."""
    at = np.maximum.accumulate(np.where(test, np.arange(len(test)), -1))
    return np.where(at >= first, at, -1)


def _first_of(changes: np.ndarray) -> np.ndarray:
    """The place of the first row of each row's group."""
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _where(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values at some places, null at -1."""
    return pa.array(values[np.maximum(at, 0)], kind, mask=at < 0)


def _place(file: np.ndarray, i: np.ndarray, code: np.ndarray, words: _Words) -> dict[str, np.ndarray]:
    """Tokens that are code, with their place in bytes, line, depth of the brackets around them and neighbours."""
    first = _first_of(_changes(file))

    def until(values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values)
        return total - (total[first] - values[first])

    size, lines = words.size[code], words.lines[code]
    opens, closes = words.isin(code, "(", "[", "{"), words.isin(code, ")", "]", "}")
    pos, line = until(size) - size, until(lines) - lines + 1
    depth = until(opens.astype(np.int64) - closes) - opens
    real = ~words.of_kind(code, "cb")
    rows = {"file": file, "i": i, "code": code, "pos": pos, "fin": pos + size, "line": line, "end_line": line + lines, "depth": depth}
    rows = {name: values[real] for name, values in rows.items()}
    first = _first_of(_changes(rows["file"]))
    rows["last"], rows["last_but_one"] = _before(rows["code"], first), _before(rows["code"], first, 2)
    rows["last_pos"] = _before(rows["pos"], first)
    rows["gap"] = rows["pos"] > _before(rows["fin"], first, none=2**62)
    rows["new_line"] = rows["line"] > _before(rows["end_line"], first, none=2**62)
    return rows


def _cut(rows: dict[str, np.ndarray], words: _Words, marks: dict[str, tuple[str, ...]]) -> dict[str, np.ndarray]:
    """The tokens in the order of their units, with the unit each belongs to and where its chain begins."""
    order = np.lexsort((np.arange(len(rows["file"])), rows["depth"], rows["file"]))
    rows = {name: values[order] for name, values in rows.items()}
    code, last = rows["code"], rows["last"]
    is_first = _changes(rows["file"], rows["depth"])
    first = _first_of(is_first)
    side = _before(code, first)
    closing = words.isin(code, ")", "]", "}")
    enters = (last < 0) | words.isin(last, "(", "[", "{") & ~closing
    entered = _latest(enters, first)  # the row that entered the bracket, -1: none did
    is_object = words.isin(rows["last_but_one"], *marks["before_object"])
    kinds = np.select([last < 0, words.isin(last, "{") & is_object, words.isin(last, "{"), words.isin(last, "[")], [1, 2, 3, 4], 5)
    around = np.where(entered >= 0, kinds[np.maximum(entered, 0)], 0)  # 0 unknown, 1 top, 2 object, 3 block, 4 [, 5 (
    goes_on_before = words.isin(code, *marks["goes_on_before"])
    side_mark = (side < 0) | words.of_kind(side, "p")
    after_block = words.isin(side, "}") & words.of_kind(code, "wdstn") & ~goes_on_before & side_mark
    line_ends = rows["new_line"] & ~goes_on_before & ~words.isin(side, *marks["goes_on_after"]) & ~words.of_kind(side, "d")
    block, listed = np.isin(around, (0, 1, 3)), ~np.isin(around, (1, 3))
    starts = is_first | enters | words.isin(side, ";") | words.isin(side, ",") & listed | block & (after_block | line_ends)
    goes_on = words.isin(side, ".", "?.") | words.isin(code, ".", "?.") | closing | words.of_kind(code, "g")
    goes_on |= words.isin(code, "(", "[") & (words.of_kind(side, "wg") | words.isin(side, ")", "]"))
    count = np.cumsum(starts)
    return rows | {
        "side": side, "enters": enters, "entered": entered, "around": around, "starts": starts, "unit": count - count[first] + 1,
        "head": _latest(enters | ~goes_on, first), "closing": closing,
    }


def _unit_rows(batch: pa.RecordBatch, file: np.ndarray, i: np.ndarray, tokens: pa.Array, marks, schema: pa.Schema) -> pa.RecordBatch:
    coded = tokens.dictionary_encode()
    words = _Words(coded.dictionary.to_pylist())
    rows = _cut(_place(file, i, coded.indices.to_numpy().astype(np.int64), words), words, marks)
    begins = np.flatnonzero(rows["starts"])
    number = np.cumsum(rows["starts"]) - 1
    ends = np.append(begins[1:], len(number)) - 1
    # A mark that ends a unit is no part of it.
    kept = ~(words.isin(rows["code"], ";", ",") & words.of_kind(rows["code"], "p") & (rows["i"] == rows["i"][ends][number]))
    sizes = np.bincount(number[kept], minlength=len(begins))
    begins, full = begins[sizes > 0], sizes[sizes > 0]
    entered, first_pos = rows["entered"], rows["last_pos"]
    inside = np.where(entered >= 0, first_pos[np.maximum(entered, 0)], -1)[begins]
    around = pa.array(["t", "o", "b", "[", "("]).take(pa.array(rows["around"][begins] - 1, pa.int64(), mask=rows["around"][begins] == 0))
    head, side = rows["head"], rows["side"]
    head_side = np.where(head >= 0, np.where(rows["enters"] | (side < 0), len(words.tokens), side)[np.maximum(head, 0)], -1)
    outer = {name: rows[name][begins] for name in ("file", "depth", "unit")}
    code = rows["code"][kept]
    not_first = rows["last"][kept] >= 0
    gap = rows["gap"][kept]
    spaced = np.array(words.pieces + [" " + p for p in words.pieces], object)
    pieces = spaced[code + len(words.tokens) * (gap & ~rows["closing"][kept])].tolist()
    bounds = np.concatenate([[0], np.cumsum(full)])
    flat = ["".join(pieces[a:b]).strip(" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    texts = pa.array(words.tokens + [""], pa.string())
    head = head[kept]
    struct = schema.field("toks").type.value_type
    token = pa.StructArray.from_arrays(
        [
            pa.array(rows["i"][kept], pa.int32()), texts.take(pa.array(code)), pa.array(words.kinds).take(pa.array(code)),
            pa.array(rows["pos"][kept]), pa.array(rows["fin"][kept]), pa.array(rows["line"][kept], pa.int32()),
            pa.array(rows["end_line"][kept], pa.int32()), pa.array(gap, mask=~not_first), _where(rows["pos"], head, pa.int64()),
            _where(rows["line"], head, pa.int32()), texts.take(pa.array(head_side[kept], pa.int64(), mask=head < 0)),
        ],
        fields=list(struct),
    )
    toks = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), token, type=schema.field("toks").type)
    start, end = bounds[:-1], bounds[1:] - 1
    owner = pa.array(outer["file"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("project_id").take(owner), batch.column("file_path").take(owner), pa.array(outer["depth"], pa.int32()),
            pa.array(outer["unit"]), toks, pa.array(inside), around, pa.array(rows["pos"][kept][start]), pa.array(rows["fin"][kept][end]),
            pa.array(rows["line"][kept][start], pa.int32()), pa.array(rows["end_line"][kept][end], pa.int32()), pa.array(flat, pa.string()),
        ],
        schema=schema,
    )


def unit_batches(schema: pa.Schema, marks: dict[str, tuple[str, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from ``project_id, file_path, tokens, places`` to units.

    ``places`` numbers the tokens of a file; null: from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            share = np.cumsum(sizes) // _BATCH_TOKENS
            for begin in np.flatnonzero(_changes(share)).tolist():
                until = int(np.searchsorted(share, share[begin], "right"))
                part, count = batch.slice(begin, until - begin), sizes[begin:until]
                if not count.sum():
                    continue
                file = np.repeat(np.arange(len(count)), count)
                i = np.arange(len(file)) - np.repeat(np.cumsum(count) - count, count)
                for row in np.flatnonzero(part.column("places").is_valid().to_numpy(zero_copy_only=False)).tolist():
                    i[file == row] = part.column("places")[row].as_py()
                yield _unit_rows(part, file, i, part.column("tokens").flatten(), marks, schema)

    return run
