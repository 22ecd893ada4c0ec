"""Text functions as columns. Only Unicode normalisation and token windows leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: White space as text policies define it: more than Java's \s.
SPACE = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"

#: The same for Python: Java's \\s is ASCII only.
_SPACES = " \\t\\n\\x0b\\f\\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORDS = re.compile(f"[^{_SPACES}]+")


def nfkc_of(s: str) -> str:
    """nfkc of one Python string."""
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


def _form(form: str):
    @F.pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normal


def nfc(c: Column) -> Column:
    return _form("NFC")(c)


def nfkc(c: Column) -> Column:
    return _form("NFKC")(c)


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def line_ends(c: Column) -> Column:
    """Without a byte order mark, and with LF as the only line end."""
    return F.regexp_replace(F.regexp_replace(c, "^\\x{feff}", ""), "\r\n?", "\n")


def canonical_text(c: Column) -> Column:
    return nfc(line_ends(c))


def analysis_text(c: Column, normal=nfkc) -> Column:
    """For matching: NFKC, lower case, collapsed."""
    return collapsed(F.lower(normal(c)))


query_text = analysis_text


def query_text_native(c: Column) -> Column:
    """query_text of text that is in NFKC already, for use inside lambdas."""
    return collapsed(F.lower(c))


def selection_text(c: Column, normal=nfkc) -> Column:
    """NFKC and collapsed, with its case."""
    return collapsed(normal(c))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def token_estimate(c: Column) -> Column:
    """A quarter, rounded up, of each run of Latin letters and numbers, and one for every other visible character."""
    runs = F.regexp_extract_all(c, F.lit("[\\p{IsLatin}\\p{N}]+"), F.lit(0))
    rest = F.regexp_count(c, F.lit("[^\\p{IsLatin}\\p{N}\\p{IsWhite_Space}\\p{Cc}]"))
    return (F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.ceil(F.length(r) / 4)) + rest).cast("long")


def units(c: Column) -> Column:
    return F.length(c).cast("long")


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def word_terms(c: Column) -> Column:
    """Runs of letters, numbers, marks and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}\\p{M}_]+"), F.lit(0))


@lru_cache(1)
def _marked() -> re.Pattern:
    return re.compile("[\\w" + "".join(re.escape(ch) for ch in map(chr, range(0x300, 0x110000)) if unicodedata.category(ch)[0] == "M") + "]+")


_LETTERS, _FAR = re.compile(r"\w+"), re.compile("[\u0300-\U0010ffff]")


def term_list(s: str | None) -> list[str]:
    """word_terms of one Python string. Below U+0300 there are no marks, so that \\w says the same."""
    low = (s or "").lower()
    return (_LETTERS if low.isascii() or not _FAR.search(low) else _marked()).findall(low)


def ngrams(c: Column, n: int) -> Column:
    """Every n characters in order, in one pass; none if there are fewer."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def character_trigrams(c: Column) -> Column:
    """Trigrams without white space; the whole text if it is shorter."""
    s = F.regexp_replace(c, SPACE + "+", "")
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < 3, F.array(s)).otherwise(ngrams(s, 3))


def bigrams(c: Column) -> Column:
    return F.array_distinct(ngrams(c, 2))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(bigrams(a), bigrams(b))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, SPACE + "+"), lambda t: t != ""))


def token_list(s: str | None) -> list[str]:
    """tokens of one Python string, with repeats."""
    return [] if s is None else _WORDS.findall(s)


def collapsed_lower(s: str | None) -> str | None:
    """query_text_native of one Python string."""
    return None if s is None else " ".join(_WORDS.findall(s.lower()))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def clamp(c: Column) -> Column:
    """Into [0, 1]; what is not finite counts as 0."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


_ENDS = ".!?\u3002\uff01\uff1f"


def sentence_parts(c: Column) -> Column:
    """Sentences with the white space after them."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"[^{_ENDS}]*[{_ENDS}]{SPACE}*|[^{_ENDS}]+"), F.lit(0)), lambda x: x != "")


def sentence_count(c: Column) -> Column:
    """The number of sentence_parts, which are not made: each end mark closes one, and what follows the last one's white space is one more."""
    return F.regexp_count(c, F.lit(f"[{_ENDS}]")) + F.when((c == "") | c.rlike(f"[{_ENDS}]{SPACE}*+\\z"), 0).otherwise(1)


def line_parts(c: Column) -> Column:
    """Lines with their line ends."""
    return F.filter(F.regexp_extract_all(c, F.lit("[^\n]*\n|[^\n]+"), F.lit(0)), lambda x: x != "")


def line_lengths(c: Column) -> Column:
    """The lengths of line_parts."""
    parts = F.split(c, "\n")
    return F.filter(F.transform(parts, lambda x, i: F.length(x) + F.when(i < F.size(parts) - 1, 1).otherwise(0)), lambda n: n > 0)


@lru_cache(1 << 16)
def _weight(ch: str) -> int:
    """1 for a character of a run, 2 for a visible one that stands alone, 0 for others."""
    cat = unicodedata.category(ch)
    if ch in "\u00aa\u00ba" or cat[0] == "N" or (cat[0] == "L" and "LATIN" in unicodedata.name(ch, "")):
        return 1
    return 0 if ch.isspace() or cat == "Cc" else 2


def _weighed(s: str) -> int:
    """estimate, character by character."""
    total, run = 0, 0
    for w in map(_weight, s):
        if w == 1:
            run += 1
        else:
            total, run = total - (-run // 4) + (w == 2), 0
    return total - (-run // 4)


def _near(w: int) -> str:
    return "".join(re.escape(ch) for ch in map(chr, range(0x250)) if _weight(ch) == w)


#: Quarters of runs and single visible characters below U+0250, one token each, and what lies beyond.
_PARTS, _BEYOND = re.compile(f"[{_near(1)}]{{1,4}}|[{_near(2)}]"), re.compile("[\u0250-\U0010ffff]")
#: Texts up to this length are kept with their estimates, as blocks are asked for several times.
_SHORT = 4096


def _parts(s: str) -> int:
    return _weighed(s) if not s.isascii() and _BEYOND.search(s) else len(_PARTS.findall(s))


_known = lru_cache(1024)(_parts)


def estimate(s: str) -> int:
    """token_estimate of one Python string."""
    return _known(s) if len(s) <= _SHORT else _parts(s)


def windows(s: str, target: int, most: int) -> list[tuple[int, int]]:
    """Consecutive (start, end): each the longest prefix within target tokens, else within most, else one character. One pass: a prefix's estimate never falls."""
    out, at, n = [], 0, len(s)
    weights = list(map(_weight, s))
    while at < n:
        total, run, ends = 0, 0, [at, at]
        for i in range(at, n):
            if weights[i] == 1:
                run += 1
            else:
                total, run = total - (-run // 4) + (weights[i] == 2), 0
            now = total - (-run // 4)
            if now <= target:
                ends[0] = i + 1
            if now <= most:
                ends[1] = i + 1
            if now > target and (ends[0] > at or now > most):
                break
        end = ends[0] if ends[0] > at else max(ends[1], at + 1)
        out.append((at, end))
        at = end
    return out


def token_windows(c: Column, target: int = 320, most: int = 480) -> Column:
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else [{"start": a, "end": z} for a, z in windows(x, target, most)])

    return run(c)


def allowed_keyword(c: Column) -> Column:
    """One to 64 characters, at least two of them or a single number."""
    return (F.length(c) <= 64) & ((F.length(c) >= 2) | c.rlike("^\\p{N}$"))


def meaning_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and numbers that are not all numbers."""
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda t: (t != "") & ~t.rlike("^\\p{N}+$"))


def normal_list(c: Column) -> Column:
    """Sorted distinct collapsed entries, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, collapsed), lambda x: x != "")))


def sorted_unique(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c)) == c


def column_groups(c: Column, size: int = 256) -> Column:
    """Sorted names in arrays of at most `size`."""
    names = F.array_sort(c)
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / size).cast("int") - 1), lambda i: F.slice(names, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def path_parameters(c: Column) -> Column:
    """Names in braces in an HTTP path."""
    return F.regexp_extract_all(c, F.lit("\\{([^{}/]+)\\}"), F.lit(1))


def path_mismatch(path: Column, declared: Column) -> Column:
    """Placeholders without a declared parameter and the other way round."""
    p = path_parameters(path)
    return F.concat(F.array_except(p, declared), F.array_except(declared, p))


def prompt_tokens(c: Column, overhead: int = 0) -> Column:
    """A quarter of the length, or the number of non-ASCII characters if that is more."""
    return (F.greatest(F.ceil(F.length(c) / 4), F.regexp_count(c, F.lit("[^\\x00-\\x7F]")).cast("long")) + overhead).cast("long")


def duration(ms: Column) -> Column:
    """Two largest units of a number of milliseconds."""
    s = F.floor(ms / 1000)
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    text = lambda *x: F.concat(*[y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x])
    return F.when(d > 0, text(d, "d ", h, "h")).when(h > 0, text(h, "h ", m, "m")).when(m > 0, text(m, "m ", s % 60, "s")).otherwise(text(s, "s"))


def elapsed_ms(a: Column, b: Column) -> Column:
    """From a to b; null if unknown or negative."""
    e = F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))
    return F.when(e >= 0, e)


def backoff_ms(n: Column, base: int = 1000, most: int = 300_000) -> Column:
    """Wait before attempt n: doubles each time, up to a limit."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), n - 1), F.lit(float(most))).cast("long")


def semantic_score(cosine: Column, floor: float = 0.75) -> Column:
    """0 under the floor, then linear to 1."""
    return F.when(F.isnan(cosine) | (cosine < floor), 0.0).otherwise(clamp((cosine - floor) / (1 - floor)))


def hybrid_score(lexical: Column, semantic: Column, bonus: float = 0.1) -> Column:
    return clamp(F.greatest(lexical, semantic) + bonus * F.least(lexical, semantic))


def reciprocal(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank); a rank that is not a whole number from 1 is refused."""
    ok = (rank >= 1) & (rank == F.floor(rank))
    return F.when(ok, F.lit(1.0) / (k + rank)).otherwise(F.raise_error(F.lit("a rank must be a whole number from 1")).cast("double"))


def is_digest(c: Column) -> Column:
    return c.rlike("^sha256:[0-9a-f]{64}$")


def is_id(c: Column, prefix: str) -> Column:
    return c.rlike(f"^{prefix}_[a-z0-9-]+$")


def is_uuid7(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_timestamp(c: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return c.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z$") & F.try_to_timestamp(c).isNotNull()


def failure_code(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_]{0,63}$")
