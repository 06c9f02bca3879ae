"""Secret scan: sliding-window Shannon entropy by character class over candidate strings.

A candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of at least ``MIN_LENGTH`` characters. It belongs to the narrowest
class that holds all of it: ``hex`` (letters of one case only), ``alnum`` (digits and letters of one case) or
``base64``. A window of ``WINDOW`` characters slides over it; counts of characters, and with them the window's entropy, change by one character out and one
in. A candidate whose highest window entropy reaches its class's threshold is a finding unless the allow-list names it:

* what a prefix names as a public digest or commit, UUIDs, and subresource hashes;
* runs made of words and numbers only, joined by ``+ / _ -``: a word has one case, or single capitals where a part of three letters, or one like ``Id``, begins (``getElementById``).
  So digits alone are spared (sixteen of them reach 3.25 bits at most, and account numbers are left to other tools), as are letters of one case;
* runs with a marker of an example (``EXAMPLE``, ``xxxxxxxx``), if each segment between slashes has a marker, is made of words, or is shorter than a candidate;
  an example's name in a path doesn't clear a key that stands in another segment.

Defined results: null and empty texts have no findings; a row that occurs twice is reported twice; no limit on text
length or findings a text; other columns of the table, whatever their names, are ignored by ``secret_findings`` and kept
by ``redact_secrets``, which sets a length anew only where its column holds whole numbers; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

WINDOW = 16
MIN_LENGTH = 16
#: Bits a character.
THRESHOLDS = {"hex": 2.6, "alnum": 3.0, "base64": 3.4}
#: What is never a secret: a prefix that names a public digest or commit, matched with the candidate, and whole strings.
ALLOW_PREFIX = r"(?:commit |sha1:|sha256:|sha512:|md5:)"
_PART = "(?:[A-Z][a-z]{2,}|As|At|By|Db|Do|Id|If|In|Ip|Is|My|No|Of|On|Or|To|Up)"
_WORD = rf"(?:[A-Z]*[a-z]{{2,}}{_PART}*[A-Z]*|[A-Z]+[a-z]?|[a-z]|[0-9]+)"
_SEGMENT = rf"{_WORD}?(?:[+_\-]+{_WORD})*[+_\-]*"
_MARK = r"(?:EXAMPLE|example|0123456789|abcdefghij|xxxxxxxx|XXXXXXXX)"
ALLOW_WHOLE = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"sha(?:256|384|512)-.*",
    rf"{_SEGMENT}(?:/{_SEGMENT})*",
)
_SPARED = rf"(?:[^/]{{0,{MIN_LENGTH - 1}}}|{_SEGMENT}|[^/]*{_MARK}[^/]*)"
#: The rule of markers as one expression, for a matcher that doesn't backtrack; ``_allowed`` says the same.
ALLOW_MARKED = rf"(?:{_SPARED}/)*[^/]*{_MARK}[^/]*(?:/{_SPARED})*"
RUN = r"[A-Za-z0-9+/_\-]"
CANDIDATE = ALLOW_PREFIX + "?" + RUN + "{%d,}" % MIN_LENGTH
#: The same strings; the look-behind only spares the matcher the starts inside a run.
_SCAN = re.compile("%s%s{%d,}|(?<!%s)%s{%d,}" % (ALLOW_PREFIX, RUN, MIN_LENGTH, RUN, RUN, MIN_LENGTH))
_PREFIX = re.compile(ALLOW_PREFIX)
_WHOLE = re.compile("|".join(f"(?:{x})" for x in ALLOW_WHOLE))
_WORDS, _MARKED = re.compile(_SEGMENT), re.compile(_MARK)
_CLASSES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("alnum", re.compile(r"[0-9a-z]+|[0-9A-Z]+")), ("base64", re.compile(RUN + "+")))
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

FINDINGS = "doc_id long, start int, length int, char_class string, entropy double"


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits a character, of any ``window`` successive characters; a shorter text is one window."""
    window = min(window, len(text))
    if not window:
        return 0.0
    table = _C_LOG_C if window <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for c in text[:window]:
        n = counts.get(c, 0)
        total += table[n + 1] - table[n]
        counts[c] = n + 1
    least = total
    for gone, come in zip(text, text[window:]):
        if gone != come:
            n = counts[gone]
            total += table[n - 1] - table[n]
            counts[gone] = n - 1
            n = counts.get(come, 0)
            total += table[n + 1] - table[n]
            counts[come] = n + 1
            if total < least:
                least = total
    return math.log2(window) - least / window


def _allowed(run: str) -> bool:
    if _PREFIX.match(run) or _WHOLE.fullmatch(run):
        return True
    return bool(_MARKED.search(run)) and all(len(s) < MIN_LENGTH or _MARKED.search(s) or _WORDS.fullmatch(s) for s in run.split("/"))


def scan_text(text: str) -> list[tuple[int, int, str, float]]:
    """(start, length, class, entropy) of each finding, by start; offsets count code points."""
    found = []
    for m in _SCAN.finditer(text):
        run = m.group()
        if _allowed(run):
            continue
        name = next(k for k, p in _CLASSES if p.fullmatch(run))
        entropy = round(window_entropy(run), 4)
        if entropy >= THRESHOLDS[name]:
            found.append((m.start(), len(run), name, entropy))
    return found


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a finding. Texts without a candidate never leave the JVM."""

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in scan_text(t)]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))],
                    names=["doc_id", "start", "length", "char_class", "entropy"],
                )

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col(text_col).rlike("(?<!%s)%s{%d,}" % (RUN, RUN, MIN_LENGTH)))
    return some.mapInArrow(scan, FINDINGS)


def redact_text(text: str, mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, length, _, _ in scan_text(text):
        out += [text[at:start], mask]
        at = start + length
    return "".join([*out, text[at:]]) if at else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each finding replaced by ``[SECRET]`` and, where the table has it as a whole number, the text's length set anew.

    All rows are kept. Only texts with a candidate are made into Python strings; columns without a finding are passed on as they are.
    """
    schema = docs.schema

    def redact(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                k = batch.schema.get_field_index(text_col)
                texts = batch.column(k)
                some = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, RUN + "{%d,}" % MIN_LENGTH), False)).to_numpy()
                new = {i: r for i, t in zip(some.tolist(), texts.take(pa.array(some)).to_pylist()) if (r := redact_text(t)) is not t}
                if new:
                    columns = list(batch.columns)
                    at = pa.array([i in new for i in range(len(texts))])
                    columns[k] = pc.replace_with_mask(texts, at, pa.array(new.values(), texts.type))
                    n = batch.schema.get_field_index(length_col)
                    if n >= 0 and pa.types.is_integer(columns[n].type):
                        columns[n] = pc.replace_with_mask(columns[n], at, pa.array(map(len, new.values()), pa.int64()).cast(columns[n].type, safe=False))
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return docs.mapInArrow(redact, schema)


#: The same in DuckDB's SQL, for the whole table ``documents``.
FINDINGS_SQL = rf"""
with pieces as (
  select doc_id, regexp_extract_all(text, '{CANDIDATE}') as runs, regexp_split_to_array(text, '{CANDIDATE}') as gaps
  from documents where text is not null),
placed as (
  select doc_id, unnest(range(1, len(runs) + 1)) as k, runs, gaps from pieces where len(runs) > 0),
cands as (
  select doc_id, k, runs[k] as run,
    cast(list_sum([length(x) for x in gaps[1:k]]) + coalesce(list_sum([length(x) for x in runs[1:k - 1]]), 0) as int) as start
  from placed),
classed as (
  select *, case when regexp_full_match(run, '[0-9a-f]+|[0-9A-F]+') then 'hex'
                 when regexp_full_match(run, '[0-9a-z]+|[0-9A-Z]+') then 'alnum' else 'base64' end as char_class
  from cands
  where not regexp_matches(run, '^{ALLOW_PREFIX}') and not regexp_full_match(run, '{"|".join((*ALLOW_WHOLE, ALLOW_MARKED))}')),
windows as (
  select doc_id, k, start, run, char_class, unnest(range(1, length(run) - {WINDOW} + 2)) as w from classed),
chars as (
  select doc_id, k, start, run, char_class, w, unnest(string_split(substr(run, w, {WINDOW}), '')) as c from windows),
counts as (
  select doc_id, k, start, run, char_class, w, c, count(*) as n from chars group by all),
entropies as (
  select doc_id, k, start, run, char_class, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} as h from counts
  group by doc_id, k, start, run, char_class, w)
select doc_id, start, cast(length(run) as int) as length, char_class, round(max(h), 4) as entropy
from entropies group by doc_id, k, start, run, char_class
having round(max(h), 4) >= case char_class when 'hex' then {THRESHOLDS['hex']}
  when 'alnum' then {THRESHOLDS['alnum']} else {THRESHOLDS['base64']} end
"""
