"""Links within a repository's documents: every relative target and every fragment must exist.

Bodies are read block by block: fences, indented code and code spans hold no links, ``[label]: target`` lines are definitions for
the whole document, and a link's line is that on which its block (a heading, or lines without a blank one between) begins.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TEXT = r"\[((?:[^\[\]\\]|\\.|!?\[[^\[\]]*\](?:\([^()]*\))?)*)\]"
_LINK = re.compile(
    rf"<([A-Za-z][A-Za-z0-9+.\-]{{1,31}}:[^\s<>]*)>|(?<![!\\]){_TEXT}"
    r"(?:\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\<]|\\.)(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[((?:[^\[\]\\]|\\.)*)\])?"
)
_ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _blocks(body: str) -> list[tuple[int, str]]:
    """(line, text) of each block outside code."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    first, fence = 0, None
    for number, line in enumerate(body.replace("\r\n", "\n").replace("\r", "\n").split("\n") + [""], 1):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        opens = m and (m[1][0] == "~" or "`" not in m[2])
        alone = bool(_HEADING.match(line))
        if held and (opens or alone or not line.strip()):
            out.append((first, "\n".join(held)))
            held = []
        if opens:
            fence = m[1]
        elif alone:
            out.append((number, line))
        elif line.strip() and (held or not re.match(r" {4}| {0,3}\t", line)):
            first = first if held else number
            held.append(line)
    return out


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def extract(body: str) -> list[tuple[int, str]]:
    """(line, target) of each link, in order: inline, by reference and in angle brackets; images are none."""
    known: dict[str, str] = {}
    rest = []
    for line, text in _blocks(body):
        kept = []
        for part in text.split("\n"):
            if not any(kept) and (m := _DEFINITION.match(part)):
                known.setdefault(_label(m[1]), m[2] if m[2] is not None else m[3])
            else:
                kept.append(part)
        rest.append((line, _CODE.sub(lambda m: " " * len(m[0]), "\n".join(kept))))
    out = []
    for line, text in rest:
        for m in _LINK.finditer(text):
            auto, words, angle, plain, label = m.groups()
            inline = m[0].endswith(")") and not m[0].endswith("]") and auto is None
            target = auto if auto is not None else (angle or plain) if inline else known.get(_label(label or words))
            if target:
                out.append((line, target))
    return out


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.count = 0

    def handle_starttag(self, tag, attrs):
        self.count += tag == "a" and any(k == "href" for k, _ in attrs)


def anchors(body: str) -> list[int]:
    """The line of each raw ``<a href>``, which is no link to ``extract``; comments and scripts hold none."""
    out = []
    for line, text in _blocks(body):
        found = _Anchors()
        found.feed(_CODE.sub(" ", text))
        found.close()
        out += [line] * found.count
    return out


def links(docs: DataFrame) -> DataFrame:
    """(path, line, target) of the links in (path, body)."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("target", pa.string())]))

    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([[{"line": n, "target": t} for n, t in extract(b or "")] for b in bodies.to_pylist()], kind)

    found = F.arrow_udf(run, "array<struct<line:int,target:string>>")(F.col("body"))
    return docs.where("body like '%]%' or body like '%<%'").select("path", F.inline(found))


def anchor_lines(docs: DataFrame) -> DataFrame:
    """(path, line) of each raw anchor with a target in (path, body)."""

    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([anchors(b or "") for b in bodies.to_pylist()], pa.list_(pa.int32()))

    return docs.where("lower(body) like '%<a%'").select("path", F.explode(F.arrow_udf(run, "array<int>")(F.col("body"))).alias("line"))


def raw_anchors(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, n_anchors): ``<a href>`` tags of HTML."""
    return pages.select(id_col, F.size(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_ANCHOR), 0)).alias("n_anchors"))


def resolved(found: DataFrame) -> DataFrame:
    """(path, line, target, file, fragment) of relative links; ``file`` is null where ``..`` leads out of the repository."""
    relative = found.where(~F.col("target").rlike(r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:|//|/)"))
    name = F.regexp_replace(F.substring_index("target", "#", 1), r"\?.*\z", "")
    folder = F.regexp_extract("path", r"\A(.*/)?[^/]*\z", 1)
    steps = F.filter(F.split(F.concat(folder, F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)), "/"), lambda x: ~x.isin("", "."))
    out = F.aggregate(
        steps,
        F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at")),
        lambda s, x: F.struct(
            (s["ok"] & ((x != "..") | (F.size(s["at"]) > 0))).alias("ok"),
            F.when(x == "..", F.slice(s["at"], F.lit(1), F.greatest(F.lit(0), F.size(s["at"]) - 1))).otherwise(F.array_append(s["at"], x)).alias("at"),
        ),
    )
    file = F.when(name == "", F.col("path")).otherwise(F.when(out["ok"], F.array_join(out["at"], "/")))
    fragment = F.when(F.instr("target", "#") > 0, F.regexp_extract("target", r"#(.*)\z", 1))
    return relative.select("path", "line", "target", file.alias("file"), fragment.alias("fragment"))


def broken(docs: DataFrame, headings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, target, why) of links whose file is none of ``files`` (path) or whose fragment is no heading (file_id = path, slug) of it."""
    found = resolved(links(docs))
    out = found.where("file is null").select("path", "line", "target", F.lit("escapes").alias("why"))
    inside = found.where("file is not null")
    known = files.select(F.col("path").alias("file"))
    absent = inside.join(known, "file", "left_anti").select("path", "line", "target", F.lit("no such file").alias("why"))
    ids = headings.select(F.col("file_id").alias("file"), F.col("slug").alias("fragment"))
    pointed = inside.where("fragment is not null and fragment <> ''").join(known, "file", "left_semi")
    lost = pointed.join(ids, ["file", "fragment"], "left_anti").select("path", "line", "target", F.lit("no such heading").alias("why"))
    return out.union(absent).union(lost)
