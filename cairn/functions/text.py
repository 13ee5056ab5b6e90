"""Scalar text functions: tokens, normal forms, hashes, JSON in text, hints. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore in any script (what \w means for Unicode text).
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"(?U)\s+"

# Seconds of a unit in a wait hint.
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order, repeats kept; numbers are cut at points."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """White space separated pieces without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normal_question(text: Column) -> Column:
    """Runs of non-word characters as one blank, lower case, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def collapsed(text: Column) -> Column:
    """Lower case with white space runs as one blank, trimmed: the key of a question lookup."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def noise_fraction(text: Column) -> Column:
    """Share of white space tokens that are bare numbers (sign, digits, points, commas, per cent)."""
    own = words(text)
    numbers = F.size(F.filter(own, lambda w: w.rlike(r"^[-+−]?[\p{Nd}.,]+%?$")))
    return numbers / F.greatest(F.size(own), F.lit(1))


def md5_bucket(key: Column, buckets: int) -> Column:
    """The md5 of a key, read as one 128-bit number, modulo ``buckets``; digits are folded so that nothing overflows."""
    digest = F.md5(key)
    digit = lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda acc, i: (acc * 16 + digit(i)) % buckets)


def paper_split(paper: Column, test_share: int = 300) -> Column:
    """'test' for ``test_share`` in 1000 papers by hash, else 'train'."""
    return F.when(md5_bucket(paper, 1000) < test_share, "test").otherwise("train")


def question_id(kind: Column, question: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.substring(F.sha1(question.cast("binary")), 1, 8))


def sha256_lf(text: Column) -> Column:
    """sha256 with CRLF line ends read as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def greedy_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def greedy_array(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


#: Characters with a short escape in JSON.
JSON_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(text: Column) -> Column:
    """A text as a JSON string literal in ASCII: what is not is written as its UTF-16 units in hex."""

    def one(c: Column) -> Column:
        out = F.when(c.rlike(r"[^\x20-\x7f]"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")).otherwise(c)
        for k, v in JSON_ESCAPES.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    special = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[^\x20-\x7f]|[\"\\\\]"), special).otherwise(text), F.lit('"'))


def without_comments(json: Column) -> Column:
    """JSON text without // comments to the line's end."""
    return F.regexp_replace(json, r"//[^\n]*", "")


def wait_seconds(message: Column) -> Column:
    """Seconds of a 'try again in 1m30.5s' hint; null without one."""
    hint = F.regexp_extract(message, r"(?i)try again in\s+((?:\d+(?:\.\d+)?(?:ms|h|m|s)\s*)+)", 1)
    part = r"(?i)(\d+(?:\.\d+)?)(ms|h|m|s)"
    amounts, units = F.regexp_extract_all(hint, F.lit(part), F.lit(1)), F.regexp_extract_all(hint, F.lit(part), F.lit(2))
    unit = lambda u: F.coalesce(*[F.when(F.lower(u) == k, F.lit(v)) for k, v in UNIT_SECONDS.items()])
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.cast("double") * unit(u)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(hint != "", total)


def review_mode(notes: Column) -> Column:
    """The first ``review:`` tag of white space separated notes; null without one."""
    tags = F.filter(words(notes), lambda t: t.startswith("review:"))
    return F.regexp_replace(F.get(tags, F.lit(0)), r"^review:", "")


def with_review_mode(notes: Column, mode: Column) -> Column:
    """Notes with older review tags removed and this one added."""
    rest = F.filter(words(F.coalesce(notes, F.lit(""))), lambda t: ~t.startswith("review:"))
    return F.array_join(F.concat(rest, F.array(F.concat(F.lit("review:"), mode))), " ")


def quota_exhausted(message: Column) -> Column:
    """True where a provider's message speaks of a used-up quota."""
    return F.coalesce(message.rlike(r"(?i)tokens per day|requests per day|daily|quota"), F.lit(False))
