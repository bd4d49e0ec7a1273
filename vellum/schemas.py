"""Explicit schemas of the outline engine."""

from __future__ import annotations

LINES = "project string, file string, file_ord int, line_no int, line string"
MANIFEST = "title string, sections array<string>"
OPS = "array<struct<op:string,id:string,after:string,level:int,title:string,new:string,why:string>>"
PLAN = f"src string, numbering string, chained boolean, ops {OPS}"
STATS = ("display_eqs", "figures", "code_blocks")
FINDINGS = "project string, rule string, layer string, id string, title string, msg string, suggestion string"
RULES = "priority int, role string, level int, pattern string, strict_level boolean"
OUTLINES = "file string, level int, title string"
TERMS = "informal string, standard string"
OP_KINDS = ("rename", "merge_up", "relevel", "delete", "move", "insert")
LEVELS = range(1, 7)
