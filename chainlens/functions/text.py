"""Text functions of records as Spark columns, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import messages

# What counts as white space, and what is escaped.
_WHITE_SPACE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NAMED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\u0085": "\\u0085", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def csv_safe(c: Column) -> Column:
    """With a quote mark before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """Quoted if it must be."""
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def syslog_token(c: Column) -> Column:
    """For a header: white space becomes _, quotes and backslashes go; - if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, _WHITE_SPACE, "_"), r'["\\]', "")
    return F.when(t == "", F.lit("-")).otherwise(t)


def syslog_escape(c: Column) -> Column:
    """For a quoted message: nothing in it ends the quotes or the line."""
    out = c
    for raw, shown in _NAMED.items():
        out = F.replace(out, F.lit(raw), F.lit(shown))
    controls = out
    for code in range(0x20):
        if chr(code) not in _NAMED:
            controls = F.replace(controls, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.when(out.rlike(r"[\x00-\x1F]"), controls).otherwise(out)


def rfc3339(ns: Column) -> Column:
    """Nanoseconds since 1970 as a UTC time with no, 3, 6 or 9 digits of the second. It doesn't depend on the session's time zone."""
    billion = F.lit(1_000_000_000).cast("long")
    rest = F.pmod(ns, billion)
    # truncating division, less one where it rounded a negative number up
    seconds = F.call_function("div", ns, billion) - F.when((ns < 0) & (rest != 0), F.lit(1)).otherwise(F.lit(0))
    return _written(seconds, rest)


def _written(seconds: Column, rest: Column) -> Column:
    days, inside = F.floor(seconds / F.lit(86_400)).cast("int"), F.pmod(seconds, F.lit(86_400)).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(inside / 3600)), two(F.floor(F.pmod(inside, F.lit(3600)) / 60)), two(F.pmod(inside, F.lit(60))))
    nine = F.lpad(rest.cast("string"), 9, "0")
    fraction = F.when(rest == 0, F.lit("")).when(rest % 1_000_000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 3))).when(rest % 1000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 6))).otherwise(F.concat(F.lit("."), nine))
    return F.concat(day, F.lit("T"), clock, fraction, F.lit("+00:00"))


def short_hash(c: Column) -> Column:
    return F.when(F.char_length(c) > 16, F.concat(F.substring(c, 1, 16), F.lit("..."))).otherwise(c)


def hash_problem(field: str, c: Column) -> Column:
    """What is wrong with a hash of 64 lowercase hex digits; null if nothing is."""
    size = F.octet_length(c)
    at = F.regexp_instr(c, F.lit("[^0-9a-f]"))
    bad = F.substr(c, at, F.lit(1))
    upper, other = (messages.column(m, field=field, char=bad, at=at - 1) for m in (messages.BAD_CASE, messages.BAD_CHAR))
    return F.when(size != 64, messages.column(messages.BAD_LENGTH, field=field, expected="64", found=size)).when(at > 0, F.when(bad.rlike("[A-F]"), upper).otherwise(other))


def hex_problem(field: str, c: Column, digits: int) -> Column:
    """What is wrong with so many lowercase hex digits; null if nothing is, or c is null."""
    size = F.octet_length(c)
    return F.when(size != digits, messages.column(messages.BAD_LENGTH, field=field, expected=str(digits), found=size)).when(c.rlike("[^0-9a-f]"), F.lit(messages.BAD_HEX.format(field=field)))


def hash_problems(prev_hash: Column, payload_hash: Column, signature: Column, public_key: Column) -> Column:
    """All that is wrong with a record's hex fields."""
    found = F.array(hash_problem("prev_hash", prev_hash), hash_problem("payload_hash", payload_hash), hex_problem("signature", signature, 128), hex_problem("public_key", public_key, 64))
    return F.filter(found, lambda x: x.isNotNull())


def normalized_anchor(c: Column) -> Column:
    trimmed = F.regexp_replace(c, f"^{_WHITE_SPACE}+|{_WHITE_SPACE}+$", "")
    return F.lower(F.regexp_replace(trimmed, "^0[xX]", ""))


def fingerprint(c: Column) -> Column:
    return F.rpad(F.lower(F.substring(F.regexp_replace(c, "[^0-9A-Fa-f]", ""), 1, 16)), 16, "0")


#: The application that syslog lines name unless told otherwise.
APP = "chainlens"


def syslog_line(facility: int, *, sequence: Column, timestamp_ns: Column, event_type: Column, source: Column, payload_hash: Column, app: str = APP) -> Column:
    kind, host = F.coalesce(event_type, F.lit("-")), F.coalesce(source, F.lit("-"))
    number = sequence.cast("string")
    # Fixed value: the line's form.
    return F.concat(F.lit(f"<{facility * 8 + 6}>1 "), rfc3339(timestamp_ns), F.lit(" "), syslog_token(host), F.lit(f" {app} "), number, F.lit(" "), syslog_token(kind), F.lit(' - msg="seq='), number, F.lit(" type="), syslog_escape(kind), F.lit(" hash="), F.substring(payload_hash, 1, 16), F.lit('"'))


def csv_line(*, sequence: Column, timestamp_ns: Column, event_type: Column, source: Column, payload_hash: Column, prev_hash: Column, signed: Column, entry_hash: Column | None = None) -> Column:
    none = F.lit("")
    cells = [sequence.cast("string"), csv_safe(timestamp_ns.cast("string")), csv_safe(F.coalesce(event_type, none)), csv_safe(F.coalesce(source, none)), csv_safe(payload_hash), csv_safe(prev_hash), F.when(signed, F.lit("yes")).otherwise(F.lit("no"))]
    if entry_hash is not None:
        cells.append(csv_safe(entry_hash))
    return F.concat_ws(",", *map(csv_field, cells))


def rewrite_amount(line: Column, amount: str) -> Column:
    """The line with the first "amount" text replaced, byte for byte otherwise; an error if it has none."""
    pattern = r'("amount":")[^"]*(")'
    shown = amount.replace("\\", r"\\").replace("$", r"\$")
    once = F.regexp_replace(line, rf'(?s)^(.*?"amount":")[^"]*(")', f"$1{shown}$2")
    return F.when(line.rlike(pattern), once).otherwise(F.raise_error(F.lit('the target line has no "amount" field')))
