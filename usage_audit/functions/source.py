"""Splitting source files into code, comments and literals, and finding recorded references in them.

These three need a scan with state, so they run in Arrow batches; every file is handled by itself, inside its task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, compress
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xml.parsers import expat

from .. import vocabulary as V
from ..operators.graph import cut
from ..operators.joins import ROWS_OF_TASK
from . import text as T

SPLIT = "code string, comments string, literals array<string>, spans array<struct<start:int,end:int,kind:string>>"
# one alternative for each construct; an unterminated one runs to the end of the file
_PIECES = re.compile(r"""(?P<line>//[^\n]*\n?)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<single>'(?:\\.|[^'\\])*(?:'|\Z|\\\Z))|(?P<double>"(?:\\.|[^"\\])*(?:"|\Z|\\\Z))""", re.S)
_MARKUP_COMMENT = re.compile(r"<!--.*?-->", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def split_code(source: str) -> tuple[str, str, list[str], list[tuple[int, int, str]]]:
    """Code, comments, literals of two characters or more, and spans over the source.

    A comment adds nothing to the code, a line comment swallows its line feed; a closed literal becomes one space, an
    open one is dropped; a backslash keeps the next character alone.
    """
    code, comments, literals, spans, at = [], [], [], [], 0

    def span(start: int, end: int, kind: str) -> None:
        if end > start:
            if spans and spans[-1][2] == kind == "code":
                start = spans.pop()[0]
            spans.append((start, end, kind))

    for m in _PIECES.finditer(source):
        code.append(source[at : m.start()])
        span(at, m.start(), "code")
        piece, kind = m.group(), m.lastgroup
        if kind == "line":
            comments.append(piece[2:])
            end = m.end() - piece.endswith("\n")
            span(m.start(), end, "comment")
            span(end, m.end(), "code")
        elif kind == "block":
            closed = piece.endswith("*/") and len(piece) >= 4
            comments.append(piece[2:-2] + " " if closed else piece[2:])
            span(m.start(), m.end(), "comment")
        else:
            quote = piece[0]
            if len(piece) > 1 and re.fullmatch(rf"{quote}(?:\\.|[^{quote}\\])*{quote}", piece, re.S):
                value = _ESCAPE.sub(r"\1", piece[1:-1])
                if len(value) >= 2:
                    literals.append(value)
                code.append(" ")
            span(m.start(), m.end(), "literal")
        at = m.end()
    code.append(source[at:])
    span(at, len(source), "code")
    return "".join(code), "".join(comments), literals, spans


def split_xml(source: str) -> tuple[str, str, list[str], list[tuple[int, int, str]]]:
    """The same of markup: comments apart, CDATA unwrapped, no literals."""
    spans, at = [], 0
    for m in _MARKUP_COMMENT.finditer(source):
        spans += [(at, m.start(), "markup")] * (m.start() > at) + [(m.start(), m.end(), "comment")]
        at = m.end()
    spans += [(at, len(source), "markup")] * (at < len(source))
    body = _CDATA.sub(r" \1 ", _MARKUP_COMMENT.sub(" ", source))
    return body, " ".join(_MARKUP_COMMENT.findall(source)), [], spans


def split_any(suffix: str, source: str | None) -> tuple[str, str, list[str], list[tuple[int, int, str]]]:
    return split_code(source or "") if (suffix or "").lower() in V.SCANNED_SUFFIXES else split_xml(source or "")


def split_source(files: DataFrame, content: str = "content", suffix: str = "suffix") -> DataFrame:
    """`files` with code, comments, literals and spans; a null content is an empty one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [split_any(s, c) for s, c in zip(batch[suffix], batch[content], strict=True)]
            for k, name in enumerate(("code", "comments", "literals")):
                batch[name] = [p[k] for p in parts]
            batch["spans"] = [[{"start": a, "end": b, "kind": kind} for a, b, kind in p[3]] for p in parts]
            yield batch

    return files.mapInPandas(run, f"{schema}, {SPLIT}")


def dedupe_overlaps(hits: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Non-overlapping hits of each file: the first, longest one stays and lists the others' components in ``also``.

    `hits`: artifact_id, start, end, component_id, match_kind, alias_kind, region, and the columns `carried`, which follow
    from the file and the place. Hits are cut into islands, before each of which all earlier ones have ended: a running
    maximum finds them. An island is folded by itself, in order.
    """
    by = W.partitionBy("artifact_id").orderBy("start", F.desc("end"), "component_id", "match_kind", "alias_kind", "region")
    ended = F.col("start") >= F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = hits.withColumn("opens", F.coalesce(ended, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    fields = ("component_id", "match_kind", "alias_kind", "region", *carried)
    row = F.struct("start", (F.col("start") - F.col("end")).alias("size"), *fields)
    grouped = islands.groupBy("artifact_id", "island").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def put(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        new = F.struct(x["start"].alias("start"), (x["start"] - x["size"]).alias("end"), *[x[c].alias(c) for c in fields], F.array().cast("array<bigint>").alias("also"))
        known = (x["component_id"] == last["component_id"]) | F.array_contains(last["also"], x["component_id"])
        more = F.struct(last["start"].alias("start"), last["end"].alias("end"), *[last[c].alias(c) for c in fields], F.when(known, last["also"]).otherwise(F.array_append(last["also"], x["component_id"])).alias("also"))
        return F.when((F.size(kept) == 0) | (x["start"] >= F.coalesce(last["end"], F.lit(0))), F.array_append(kept, new)).otherwise(F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), more))

    more_types = "".join(f"{c}:{hits.schema[c].dataType.simpleString()}," for c in carried)
    none = F.array().cast(f"array<struct<start:int,end:int,component_id:bigint,match_kind:string,alias_kind:string,region:string,{more_types}also:array<bigint>>>")
    kept = grouped.select("artifact_id", F.explode(F.aggregate("rows", none, put)).alias("k"))
    return kept.select("artifact_id", "k.start", "k.end", *[f"k.{c}" for c in fields], "k.also")


#: A file is cut into pieces: what says nothing, and then a run of word characters, a comment, a literal or a single character.
_CODE_PIECES = re.compile(r"""[^A-Za-z0-9_$/'"]*(?:[A-Za-z0-9_$]+|//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*(?:'|\Z|\\\Z)|"(?:\\.|[^"\\])*(?:"|\Z|\\\Z)|.)""", re.S)
_MARKUP_PIECES = re.compile(r"[^A-Za-z0-9_$<]*(?:[A-Za-z0-9_$]+|<!--.*?(?:-->|\Z)|<!?-?\Z|.)", re.S)
_SILENT = {_CODE_PIECES: re.compile(r"""[^A-Za-z0-9_$/'"]*"""), _MARKUP_PIECES: re.compile(r"[^A-Za-z0-9_$<]*")}
_NAMES, _COLUMNS, _MERGE = re.compile(V.TOKEN, re.A), re.compile(V.REPORT_COLUMN, re.A), re.compile(V.MERGE_FIELD)
#: Pieces of so many characters at most are remembered, so many of them, and so many characters are cut into pieces at once.
_SHORT, _REMEMBERED, _WINDOW = 100, 1 << 18, 1 << 18
_LONG = ("long",)


class _Pieces(dict):
    """(start, end, name, match kind, region) of the `known` names in a piece. Short pieces are read once: words come again."""

    def __init__(self, known, suffix: str | None):
        self.known, self.scanned = known, (suffix or "").lower() in V.SCANNED_SUFFIXES
        self.pattern = _CODE_PIECES if self.scanned else _MARKUP_PIECES
        self.silent = _SILENT[self.pattern]
        self.free_of = known.keys().isdisjoint
        self.odd = not all(map(re.compile(V.TOKEN).fullmatch, known))  # such names only are literals as a whole

    def __missing__(self, piece: str) -> tuple:
        if len(piece) > _SHORT:
            return _LONG
        if len(self) >= _REMEMBERED:
            self.clear()
        # most pieces name nothing known; a literal that isn't made of names is asked for as a whole
        plain = "$" not in piece and not ((self.odd or not piece.isascii()) and ("'" in piece or '"' in piece))
        found = self[piece] = () if plain and self.free_of(map(str.lower, _NAMES.findall(piece))) else tuple(self.said(piece, 0, len(piece)))
        return found

    def words(self, source: str, lo: int, hi: int, match_kind: str, region: str) -> Iterator[tuple[int, int, str, str, str]]:
        found = _NAMES.finditer(source, lo, hi)
        if source.find("$", lo, hi) >= 0:  # a report column has one
            found = heapq.merge(found, _COLUMNS.finditer(source, lo, hi), key=re.Match.start)
        for m in found:
            name = m.group().lower()
            if name in self.known:
                yield m.start(), m.end(), name, match_kind, region

    def said(self, source: str, lo: int, hi: int) -> Iterator[tuple[int, int, str, str, str]]:
        """What the piece of `source` from `lo` to `hi` says, in order of start."""
        at = self.silent.match(source, lo, hi).end()
        if not self.scanned:
            closed = source.startswith("<!--", at, hi) and source.endswith("-->", at + 4, hi)
            return self.words(source, at, hi, *(("comment_mention", "comment") if closed else ("token_sweep", "markup")))
        if source.startswith(("//", "/*"), at, hi):
            return self.words(source, at, hi, "comment_mention", "comment")
        return self.literal(source, at + 1, max(at + 1, hi - 1)) if source.startswith(("'", '"'), at, hi) else self.words(source, at, hi, "token_sweep", "code")

    def literal(self, source: str, lo: int, hi: int) -> Iterator[tuple[int, int, str, str, str]]:
        inner = source[lo:hi]
        if (whole := inner.strip().lower()) in self.known:
            yield lo, hi, whole, "string_literal", "literal"
        if " " in inner:
            yield from self.words(source, lo, hi, "string_literal", "literal")


def _occurrences(source: str, pieces: _Pieces) -> Iterator[tuple[int, Iterable[tuple[int, int, str, str, str]]]]:
    """(place, hits), in order: hits are (start, end, name, match kind, region) of known names, from that place.

    Windows are cut into pieces and these are looked up by calls that loop in C; only pieces that say a name come back to
    Python. A window's last piece may go on behind it and is left to the next one.
    """
    at, window = 0, _WINDOW
    while at < len(source):
        end = min(at + window, len(source))
        found = pieces.pattern.findall(source, at, end)
        if end < len(source):
            if len(found) == 1:
                window *= 2
                continue
            found.pop()
        said = [*map(pieces.__getitem__, found)]
        for start, piece, hits in compress(zip(accumulate(map(len, found), initial=at), found, said, strict=False), said):
            yield (0, pieces.said(source, start, start + len(piece))) if hits is _LONG else (start, hits)
        at, window = at + sum(map(len, found)), _WINDOW


def _merge_fields(source: str, suffix: str | None, known) -> Iterator[tuple[int, int, str, str, str]]:
    for lo, hi, region in split_any(suffix, source)[3]:
        if region in ("code", "markup"):
            for m in _MERGE.finditer(source, lo, hi):
                said = m.group(1).strip()
                for part in dict.fromkeys([said, *(p for p in re.split(r"[.\s(),]+", said) if len(p) > 1)]):
                    if part.lower() in known:
                        yield m.start(), m.end(), part.lower(), "merge_field", region


def _found(source: str, suffix: str | None, pieces: _Pieces) -> Iterator[tuple[int, Iterable[tuple[int, int, str, str, str]]]]:
    """What _occurrences() gives, with merge fields."""
    found = _occurrences(source, pieces)
    if "{!" not in source:
        return found
    each = ((start + a, start + b, *about) for start, hits in found for a, b, *about in hits)
    return ((0, (hit,)) for hit in heapq.merge(each, _merge_fields(source, suffix, pieces.known), key=itemgetter(0)))


#: How many rows and characters of what is found are held at once.
_HELD_ROWS, _HELD_CHARACTERS = 20_000, 4_000_000
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in columns.split(", "))])


def _handed_on(rows: Iterator[tuple], columns: str, text: int) -> Iterator[pa.RecordBatch]:
    """`rows` in small batches, however many there are; column number `text` holds the most characters."""
    schema = _schema(columns)
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    held, characters = [], 0
    for row in rows:
        held.append(row)
        characters += len(row[text])
        if len(held) >= _HELD_ROWS or characters >= _HELD_CHARACTERS:
            yield made(held)
            held, characters = [], 0
    if held:
        yield made(held)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of `names` in files (artifact_id, suffix, content, names), with their first line, their place in it
    and their text. One file is scanned at a time, and what is found is handed on in small batches."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for artifact, suffix, content, names in zip(*map(batch.column, ("artifact_id", "suffix", "content", "names")), strict=True):
                key, kind, source = artifact.as_py(), suffix.as_py(), content.as_py() or ""
                is_code, places = (kind or "").lower() in V.CODE_SUFFIXES, _Places(source)
                for start, hits in _found(source, kind, _Pieces(dict.fromkeys(names.as_py()), kind)):
                    for a, b, *about in hits:
                        yield key, start + a, start + b, *about, is_code, *places.of(start + a), source[start + a : start + b]

    return _handed_on(rows(), "artifact_id long, start int, end int, alias_lc string, match_kind string, region string, is_code boolean, line int, lead int, said string", 9)


class _Places:
    """Lines of places that come in order."""

    def __init__(self, source: str):
        self.source, self.line, self.begins, self.seen = source, 0, 0, 0

    def of(self, at: int) -> tuple[int, int]:
        """(line, place in the line), both from 0."""
        feed = self.source.rfind("\n", self.seen, at)
        if feed >= 0:
            self.line += self.source.count("\n", self.seen, at)
            self.begins = feed + 1
        self.seen = at
        return self.line, at - self.begins


#: Match kinds as bits of a number.
_BITS = {"token_sweep": 1, "string_literal": 2, "merge_field": 4, "comment_mention": 8}


def _first_longest(island: list[tuple]) -> list[tuple]:
    """What dedupe_overlaps() does to hits (start, -length, component, match kind, alias kind, region) that overlap."""
    if len(island) == 1:
        a, size, component, match_kind, alias_kind, region = island[0]
        return [(a, a - size, component, match_kind, alias_kind, region, ())]
    kept = []
    for a, size, component, match_kind, alias_kind, region in sorted(island):
        if not kept or a >= kept[-1][1]:
            kept.append((a, a - size, component, match_kind, alias_kind, region, []))
        elif component != kept[-1][2] and component not in kept[-1][-1]:
            kept[-1][-1].append(component)
    return kept


def _kept(found: Iterator[tuple], known: dict[str, list], kinds: dict[int, int], guarded: dict[str, bool]) -> Iterator[tuple]:
    """(start, end, component, match kind, alias kind, region, also) of the hits that stay, of components with an edge of
    that kind. Hits are judged in islands, before each of which all earlier ones have ended."""
    island, reach = [], 0
    for start, hits in found:
        for a, b, name, match_kind, region in hits:
            bit, guard, a, b = _BITS[match_kind], guarded[match_kind], start + a, start + b
            new = [(a, a - b, c, match_kind, alias_kind, region) for c, alias_kind, sweepable in known[name] if (sweepable or not guard) and c in kinds and kinds[c] & bit]
            if not new:
                continue
            if a >= reach:
                if island:
                    yield from _first_longest(island)
                island, reach = new, b
            else:
                island += new
                reach = max(reach, b)
    yield from _first_longest(island) if island else ()


#: A line without a comment or literal that goes on behind it, and the longest line that is remembered.
_CLOSED = re.compile(r"""(?>[^/'"]++|//[^\n]*+|/\*.*?\*/|'(?:\\.|[^'\\])*+'|"(?:\\.|[^"\\])*+"|/(?![/*]))*+""", re.S)
_LINE = 200
#: Lines of code that are closed without a look at escapes; each character can be taken in one way only.
_PLAIN_CODE = r"""^(?:[^'"/$]|'[^'\\$]*'|"[^"\\$]*"|/[^*/'"$]|/$)*(?://[^$]*)?$"""
_WHOLE = ("whole",)


class _Lines(dict):
    """Hits (col, end, text, component, bit, match kind, alias kind, region) of components in a line, if they can be told
    from the line alone and don't overlap; else _WHOLE: its file is to be read as a whole."""

    def __init__(self, known: dict[str, list], suffix: str | None):
        self.known, self.suffix, self.pieces, self.names = known, suffix, _Pieces(known, suffix), pa.array(list(known), pa.string())
        is_code = (suffix or "").lower() in V.CODE_SUFFIXES
        self.guarded = {k: k == "comment_mention" or (k == "token_sweep" and not is_code) for k in _BITS}

    def __missing__(self, line: str) -> tuple:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[line] = self.read(line) if len(line) <= _LINE and "{!" not in line and self.closed(line) else _WHOLE
        return found

    def closed(self, line: str) -> bool:
        if not self.pieces.scanned:
            return "<!--" not in line
        return ("'" not in line and '"' not in line and "/*" not in line) or _CLOSED.fullmatch(line) is not None

    def read(self, line: str) -> tuple:
        hits, reach = [], 0
        for start, found in _occurrences(line, self.pieces):
            for a, b, name, match_kind, region in found:
                about = {(c, k) for c, k, sweepable in self.known[name] if sweepable or not self.guarded[match_kind]}
                if about and (len(about) > 1 or start + a < reach or a == b):
                    return _WHOLE
                for component, alias_kind in about:
                    hits.append((start + a, start + b, line[start + a : start + b], component, _BITS[match_kind], match_kind, alias_kind, region))
                    reach = start + b
        return tuple(hits)

    def silent(self, lines: pa.Array) -> np.ndarray:
        """Which `lines` surely have no hit and are closed? By whole columns, for most lines; the others are read one by one."""
        plain, low = pc.match_substring_regex(lines, _PLAIN_CODE if self.pieces.scanned else "^[^$]*$"), pc.ascii_lower(lines)
        doubts = [pc.match_substring(lines, "{!"), pc.match_substring(lines, "<!--"), pc.match_substring_regex(low, "(?:^|[^a-z0-9_])[0-9]+[a-z_]")]  # there a name begins within a word
        if self.pieces.odd:
            doubts.append(pc.match_substring_regex(lines, "['\"]"))
        words = pc.split_pattern_regex(low, "[^a-z0-9_]+")
        named = np.flatnonzero(pc.is_in(words.values, value_set=self.names).to_numpy(zero_copy_only=False))
        sure = pc.and_(pc.and_(plain, pc.string_is_ascii(lines)), pc.less_equal(pc.binary_length(lines), _LINE)).to_numpy(zero_copy_only=False)
        for doubt in doubts:
            sure = sure & ~doubt.to_numpy(zero_copy_only=False)
        sure[np.searchsorted(words.offsets.to_numpy(), named, side="right") - 1] = False
        return sure

    def segments(self, key: int | None, source: str, kinds: dict[int, int]) -> Iterator[tuple]:
        """The segments (_MARKED) of one file, read as a whole."""
        places = _Places(source)
        for a, b, component, match_kind, alias_kind, region, also in _kept(_found(source, self.suffix, self.pieces), self.known, kinds, self.guarded):
            line, col = places.of(a)
            for text in source[a:b].split("\n"):
                if text:
                    yield key, line, col, col + len(text), text, component, match_kind, alias_kind, region, also
                line, col = line + 1, 0


def _by_line(files: list[tuple], lines: _Lines) -> tuple[pa.RecordBatch | None, list[tuple]]:
    """The segments of files (key, source, component -> bits) whose lines tell all, and the other files.

    Each distinct line is looked up once; what it says is laid out for all lines like it by whole columns.
    """
    parts = pc.split_pattern(pa.array([source for _, source, _ in files], pa.string()), "\n")
    coded, begins = parts.values.dictionary_encode(), parts.offsets.to_numpy()
    same, file = coded.indices.to_numpy(), np.repeat(np.arange(len(files)), np.diff(begins))
    distinct, hits = len(coded.dictionary), []
    first, count, whole = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64), np.zeros(distinct, bool)
    asked = np.flatnonzero(~lines.silent(coded.dictionary))
    for n, line in zip(asked.tolist(), coded.dictionary.take(pa.array(asked)).to_pylist(), strict=True):
        found = lines[line]
        if found is _WHOLE:
            whole[n] = True
        else:
            first[n], count[n] = len(hits), len(found)
            hits += found
    aside = np.zeros(len(files), bool)
    aside[file[whole[same]]] = True
    others = [*compress(files, aside.tolist())]
    at = np.flatnonzero((count[same] > 0) & ~aside[file])
    if not len(at):
        return None, others
    each = count[same[at]]
    hit = np.arange(each.sum()) + np.repeat(first[same[at]] - np.cumsum(each) + each, each)
    at = np.repeat(at, each)
    col, end, text, component, bit, match_kind, alias_kind, region = zip(*hits, strict=True)

    asked = np.fromiter(chain.from_iterable(k for _, _, k in files), np.int64)
    bits = np.fromiter(chain.from_iterable(k.values() for _, _, k in files), np.int64)
    components, number = np.unique(asked, return_inverse=True)
    edges = np.repeat(np.arange(len(files)), [len(k) for _, _, k in files]) * len(components) + number
    order = np.argsort(edges)
    edges, bits = edges[order], bits[order]
    number = np.minimum(np.searchsorted(components, component), len(components) - 1)
    known = components[number] == component
    edge = file[at] * len(components) + number[hit]
    near = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
    stays = known[hit] & (edges[near] == edge) & ((bits[near] & np.array(bit)[hit]) > 0)
    hit, at = hit[stays], at[stays]
    owner, none = file[at], pa.ListArray.from_arrays(np.zeros(len(at) + 1, np.int32), pa.array([], pa.int64()))
    laid = lambda values, kind: pa.array(values, kind).take(pa.array(hit))
    ids = pa.array([key for key, _, _ in files], pa.int64()).take(pa.array(owner))
    columns = [ids, pa.array(at - begins[owner], pa.int32()), laid(col, pa.int32()), laid(end, pa.int32()), laid(text, pa.string()), laid(component, pa.int64()), *(laid(c, pa.string()) for c in (match_kind, alias_kind, region)), none]
    return pa.RecordBatch.from_arrays(columns, schema=_schema(_MARKED)), others


_MARKED = "artifact_id long, line int, col int, end_col int, text string, component_id long, match_kind string, alias_kind string, region string, also array<long>"
#: Rows of the stream that _marked() reads: of each bucket first its aliases, then of each file its edges and the file itself.
_ALIAS, _EDGE, _FILE = 0, 1, 2
#: Characters of files that are read by line at once, about; a file of more than that is read as a whole.
_AT_ONCE = 1 << 22


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Lines, list[tuple]]]:
    """Files (key, source, component -> bits) of one bucket and suffix, with what their lines say, from a stream of buckets."""

    def listed(column: pa.Array) -> list:
        whole = column.null_count and not pa.types.is_string(column.type)  # numbers would become floats
        return column.to_pylist() if whole else column.to_numpy(zero_copy_only=False).tolist()

    now, file, known, lines, held, characters = None, _groups, {}, {}, {}, 0
    for batch in batches:
        named = ("bucket", "step", "artifact_id", "component_id", "bits", "alias_lc", "alias_kind", "sweepable")
        suffixes, contents = batch.column("suffix"), batch.column("content")
        for n, (bucket, step, key, component, bits, alias, alias_kind, sweepable) in enumerate(zip(*(listed(batch.column(c)) for c in named), strict=True)):
            if bucket != now or characters >= _AT_ONCE:
                yield from ((lines[k], files) for k, files in held.items())
                held, characters = {}, 0
            if bucket != now:
                now, file, known, lines = bucket, _groups, {}, {}
            if step == _ALIAS:
                known.setdefault(alias, []).append((component, alias_kind, sweepable))
            elif step == _EDGE:
                if key != file:
                    file, kinds = key, {}
                kinds[component] = bits
            elif key == file and (source := contents[n].as_py()):
                suffix = suffixes[n].as_py()
                if suffix not in lines:
                    lines[suffix] = _Lines(known, suffix)
                held.setdefault(suffix, []).append((key, source, kinds))
                characters += len(source)
    yield from ((lines[k], files) for k, files in held.items())


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments (_MARKED) of the files in a stream of buckets, in small batches. A bucket's aliases are held, and files
    of _AT_ONCE characters, with their edges, or one larger file."""
    for lines, files in _groups(batches):
        small = [f for f in files if len(f[1]) < _AT_ONCE]
        found, others = _by_line(small, lines) if small else (None, [])
        for n in range(0, found.num_rows if found else 0, _HELD_ROWS):
            yield found.slice(n, _HELD_ROWS)
        others += [f for f in files if len(f[1]) >= _AT_ONCE]
        yield from _handed_on((row for f in others for row in lines.segments(*f)), _MARKED, 4)


#: Files that a task scans, about.
FILES_OF_TASK = 2000


def locate_references(files: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Segments (artifact_id, line, col, end_col, text, component_id, match_kind, alias_kind, region, also) of recorded edges.

    `files`: artifact_id, suffix, content; `edges`: artifact_id, component_id, match_kind; `aliases`: component_id,
    alias_lc, alias_kind. Only components with an edge of that kind from that file are marked, and never by a label or
    a stripped name. Lines and columns count from 0; a hit over several lines has a segment on each.

    Files are dealt to buckets, one a task. A bucket's stream has the aliases of the components that its edges name, each
    once, and then file by file its edges and its text: a file is found, judged, freed of overlaps and cut into lines where
    it is read, so what is found is never sorted or joined, and contents move once.
    """
    bits = F.coalesce(*[F.when(F.col("match_kind") == k, b) for k, b in _BITS.items()]).alias("bits")
    key, component = F.col("artifact_id").cast("long").alias("artifact_id"), F.col("component_id").cast("long").alias("component_id")
    wanted = edges.select(key, component, bits).dropna(subset=["component_id", "bits"])
    wanted = cut(wanted.groupBy("artifact_id", "component_id").agg(F.bit_or("bits").alias("bits")), "wanted")
    n = max(wanted.count() // ROWS_OF_TASK, files.count() // FILES_OF_TASK) + 1
    bucket = F.pmod(F.xxhash64("artifact_id"), F.lit(n)).cast("int").alias("bucket")
    able = aliases.filter(~F.col("alias_kind").isin(*V.NON_REFERENCE_KINDS)).select(component, "alias_lc", "alias_kind", T.is_sweepable("alias_lc").alias("sweepable"))
    named = wanted.select(bucket, "component_id").distinct().join(able.dropna(subset=["alias_lc"]), "component_id").withColumn("step", F.lit(_ALIAS))
    said = wanted.select(bucket, F.lit(_EDGE).alias("step"), "artifact_id", "component_id", "bits")
    whole = files.select(key, "suffix", "content").select(bucket, F.lit(_FILE).alias("step"), "artifact_id", "suffix", "content")
    stream = named.unionByName(said, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True).fillna({"component_id": -1, "bits": 0, "sweepable": False})
    order = ("bucket", F.col("step") != _ALIAS, "artifact_id", "step")
    return stream.repartitionById(n, "bucket").sortWithinPartitions(*order).mapInArrow(_marked, _MARKED)


#: Elements of a definition file that have a name.
MEMBERS = ("fields", "validationRules", "listViews", "recordTypes", "webLinks", "fieldSets", "compactLayouts", "businessProcesses", "indexes", "sharingReasons")


def spans_of_members(xml: str) -> tuple[list[tuple[str, str, int, int]], bool]:
    """(member, name, first line, last line) of the named members, from line 0, and whether the file could be parsed."""
    found, open_, path = [], [], []
    parser = expat.ParserCreate()
    words: list[str] = []

    def start(tag: str, _: dict) -> None:
        path.append(tag.rsplit(":", 1)[-1])
        words.clear()
        if path[-1] in MEMBERS and len(path) == 2:
            open_.append([path[-1], None, parser.CurrentLineNumber - 1])

    def end(tag: str) -> None:
        name = path.pop()
        if name == "fullName" and open_ and len(path) == 2 and open_[-1][1] is None:
            open_[-1][1] = "".join(words).strip()
        elif name in MEMBERS and len(path) == 1 and open_:
            member, called, first = open_.pop()
            if called:
                found.append((member, called, first, parser.CurrentLineNumber - 1))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, words.append
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        return [], False
    return found, True


def member_spans(files: DataFrame) -> DataFrame:
    """(artifact_id, complete, member, name, start_line, end_line); a file that can't be parsed has one row, not complete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, content in zip(batch["artifact_id"], batch["content"], strict=True):
                members, complete = spans_of_members(content or "")
                rows += [(i, complete, *m) for m in members] or [(i, complete, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["artifact_id", "complete", "member", "name", "start_line", "end_line"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("artifact_id", "content").mapInPandas(run, "artifact_id long, complete boolean, member string, name string, start_line int, end_line int")


def mark_definition_region(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """`segments` with region = definition inside the component's own lines.

    `spans`: artifact_id, component_id, start_line, end_line. The range join is bounded by equality on both ids.
    """
    own = spans.select("artifact_id", "component_id", "start_line", "end_line").distinct()
    keys = segments.columns
    joined = segments.join(own, ["artifact_id", "component_id"], "left")
    inside = F.coalesce(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
    rest = [c for c in keys if c != "region"]
    plain = [c for c in rest if c != "also"]
    grouped = joined.groupBy(*plain, "region").agg(F.bool_or(inside).alias("inside"), F.first("also").alias("also")) if "also" in keys else joined.groupBy(*plain, "region").agg(F.bool_or(inside).alias("inside"))
    return grouped.withColumn("region", F.when(F.col("inside"), "definition").otherwise(F.col("region"))).select(keys)
