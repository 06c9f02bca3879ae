"""Text and identifier functions as Column expressions; all of them run inside the JVM.

White space means what Python's ``str.strip`` takes for it, which is more than Java's ``\\s`` and ``trim`` know.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode white space character except the line feed.
BLANK = r"\t\x0B\f\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same as characters.
_BLANKS = "\t\x0b\f\r" + "".join(map(chr, [*range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NAME = r"[A-Za-z0-9][A-Za-z0-9_\-]*"
_MARKER = rf"(?:\A|[{BLANK}\n]+)\{{#({_NAME})\}}(?:[{BLANK}\n]*\z|[{BLANK}\n]+(?=#+[{BLANK}\n]*\z))"
_CONTROL = r"[\x00-\x1F\x7F-\x9F]"

LADDER = ("exploratory", "derived", "binding")
#: Ticket state types that are graded; the others say nothing about a shipped specification.
SEVERITY = {"completed": "DANGER", "started": "WARNING", "unstarted": "INFO", "backlog": "INFO"}
SEVERITY_ORDER = ("DANGER", "BLOCKED", "WARNING", "INFO")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_newlines(x: Column | str) -> Column:
    """CRLF and lone CR become LF."""
    return F.when(F.instr(_c(x), "\r") > 0, F.regexp_replace(_c(x), "\r\n?", "\n")).otherwise(_c(x))


def canonicalize(x: Column | str) -> Column:
    """Newlines normalised, each line without trailing white space, no blank lines at either end."""
    trimmed = F.regexp_replace(normalize_newlines(x), rf"[{BLANK}]+(?=\n|\z)", "")
    return F.regexp_replace(trimmed, r"\A\n+|\n+\z", "")


def content_hash(x: Column | str) -> Column:
    """The first 32 hex digits of the SHA-256 of the canonical text."""
    return _hashed(canonicalize(x))


def _hashed(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical.cast("binary"), 256), 1, 32)


def trimmed_lines(lines: Column) -> Column:
    """Lines without trailing white space; what follows has then no need of patterns. For texts without CR."""
    return F.transform(lines, lambda x: F.rtrim(x, F.lit(_BLANKS)))


def trimmed_hash(lines: Column) -> Column:
    """``content_hash`` of ``trimmed_lines`` put together."""
    return _hashed(F.btrim(F.array_join(lines, "\n"), F.lit("\n")))


def body_lines(x: Column | str) -> Column:
    """Lines by LF alone; one trailing empty line doesn't count."""
    parts = F.split(_c(x), "\n", -1)
    return F.when(_c(x).endswith("\n") | (_c(x) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(body_lines(x)))


def strip_heading_marker(x: Column | str) -> Column:
    """A heading's source line without its trailing ``{#name}``; a closing ``##`` stays."""
    unmarked = F.when(F.instr(_c(x), "{#") > 0, F.regexp_replace(_c(x), _MARKER, " ")).otherwise(_c(x))
    return F.rtrim(unmarked, F.lit(_BLANKS + "\n"))


def section_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive), the marker taken out of the first. None if ``end`` is before ``start``."""
    some = F.slice(lines, start, F.greatest(F.lit(0), end - start + 1))
    first = F.transform(F.slice(some, F.lit(1), F.lit(1)), strip_heading_marker)
    rest = F.slice(some, F.lit(2), F.greatest(F.lit(0), F.size(some) - 1))
    return F.concat(first, rest)


def section_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(section_lines(lines, start, end), "\n")


def ref_file(ref: Column | str) -> Column:
    """The file part of a reference: all before its last ``#``."""
    return F.when(F.instr(_c(ref), "#") > 0, F.regexp_extract(_c(ref), r"(?s)\A(.*)#[^#]*\z", 1)).otherwise(_c(ref))


def ref_anchor(ref: Column | str) -> Column:
    """The anchor of a reference; null without ``#``, empty after a trailing one."""
    return F.when(F.instr(_c(ref), "#") > 0, F.substring_index(_c(ref), "#", -1))


def make_ref(file_id: Column | str, anchor: Column | str) -> Column:
    return F.when(_c(anchor).isNull(), _c(file_id)).otherwise(F.concat(_c(file_id), F.lit("#"), _c(anchor)))


def has_control(x: Column | str) -> Column:
    """Whether a C0, DEL or C1 character occurs."""
    return _c(x).rlike(_CONTROL)


def first_control(x: Column | str) -> Column:
    """The code point offset of the first control character, or null."""
    return F.when(has_control(x), F.length(F.regexp_extract(_c(x), rf"(?s)\A(.*?){_CONTROL}", 1)))


def strip_control(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), _CONTROL, "")


#: What names a team, for Python's and for Java's matcher.
TEAM_KEY = "[A-Z][A-Z0-9]*"


def is_team_key(x: Column | str) -> Column:
    return _c(x).rlike(rf"\A{TEAM_KEY}\z")


def is_ticket_id(x: Column | str) -> Column:
    """``TEAM-NUMBER`` in ASCII, without leading zeros."""
    return _c(x).rlike(r"\A[A-Z][A-Z0-9]*-(?:0|[1-9][0-9]*)\z")


def authority_rank(x: Column | str) -> Column:
    """0, 1, 2 up the ladder; null for an unknown or absent authority."""
    place = F.array_position(F.array(*map(F.lit, LADDER)), _c(x))
    return F.when(place > 0, (place - 1).cast("int"))


def severity_rank(x: Column | str) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), _c(x)) - 1).cast("int")


def ticket_severity(state_type: Column | str) -> Column:
    """The grade of a ticket's state type, null where it isn't graded."""
    out = F.lit(None).cast("string")
    for state, severity in SEVERITY.items():
        out = F.when(_c(state_type) == state, severity).otherwise(out)
    return out


def line_ending(x: Column | str) -> Column:
    """CRLF or CR if a text uses nothing else, otherwise LF."""
    crlf = F.regexp_replace(_c(x), "\r\n", "")
    return (
        F.when(F.instr(_c(x), "\r\n") > 0, F.when(crlf.rlike("[\r\n]"), "\n").otherwise("\r\n"))
        .when((F.instr(_c(x), "\r") > 0) & (F.instr(_c(x), "\n") == 0), "\r")
        .otherwise("\n")
    )


def dot_escape(x: Column | str) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mermaid_escape(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit('"'), F.lit("'"))


def label(title: Column | str, node_id: Column | str) -> Column:
    """The title, or the id where the title is null or empty."""
    return F.coalesce(F.nullif(_c(title), F.lit("")), _c(node_id))


def annotation_message(x: Column | str) -> Column:
    """Text for the message part of a workflow annotation."""
    return F.replace(F.replace(F.replace(_c(x), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_property(x: Column | str) -> Column:
    """Text for a property of a workflow annotation."""
    return F.replace(F.replace(annotation_message(x), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
