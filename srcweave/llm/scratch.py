"""Intermediate tables that go as soon as they are used up."""

from srcweave.session import Scratch

__all__ = ["Scratch"]
