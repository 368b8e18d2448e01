"""Text columns: HTML to text, chunks, tokens, hygiene, JSON salvage. JVM-side expressions, but for
character references and chunks."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Tags whose end starts a new line.
BLOCK_TAGS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4")
# Split marks from paragraph to blank (the marks of a sentence stand there twice).
SEPARATORS = ("\n\n", "\n", "。", "!", "?", ";", "!", "?", ";", ",", "，", " ")
# The same with full-width marks, for texts that use them.
WIDE_SEPARATORS = ("\n\n", "\n", "。", "!", "?", ";", "！", "？", "；", ",", "，", " ")
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
# The same characters, for Python.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def resolved(text: pd.Series) -> pd.Series:
    """Character references, named and numeric, as their characters; Spark has no function for it."""
    return text.map(html.unescape, na_action="ignore")


def html_to_text(page: Column) -> Column:
    """Scripts, styles, comments and tags go, closing block tags become line ends, character
    references are resolved, runs of blanks and of empty lines are squeezed."""
    text = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?(</\1\s*>|\z)", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    names = "|".join(BLOCK_TAGS)
    text = F.regexp_replace(text, rf"(?i)</({names})\s*>|<({names})\b[^>]*/>", "\n")
    text = F.regexp_replace(text, r"(?s)<[!/a-zA-Z][^>]*>", "")
    text = resolved(text)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def strip(text: Column) -> Column:
    """Without the white space around it, of any kind."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def split_pieces(text: str, size: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: anything longer is split by the next mark of the
    cascade, and what no mark shortens is cut hard."""
    pieces = [text]
    for mark in separators:
        pieces = [part for p in pieces for part in ((p,) if len(p) <= size else p.split(mark))]
    hard = (p[at : at + size] for p in pieces for at in range(0, len(p), size))
    return [p for p in (h.strip(BLANKS) for h in hard) if p]


def pack_pieces(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Greedy packing of the pieces up to ``size``; a new chunk starts with the last ``overlap``
    characters of the one before (so it can be longer than ``size``)."""
    done, cur, held = [], [], 0
    for piece in pieces:
        if cur and held + len(piece) > size:
            done.append("".join(cur))
            cur = [done[-1][-overlap:]] if overlap > 0 else []
            held = sum(map(len, cur))
        cur.append(piece)
        held += len(piece)
    return [*done, "".join(cur)] if cur else done


def chunk_array(text: Column, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> Column:
    """The pieces of a text packed to chunks, row by row in batches: a column expression would build
    an array of all pieces anew for every mark and every chunk."""

    @F.pandas_udf(ArrayType(StringType()))
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_pieces(split_pieces(t, size, separators), size, overlap), na_action="ignore")

    return chunked(text)


CJK = r"[\u3400-\u9fff]"


def tokens(text: Column, cjk_bigrams: bool = False) -> Column:
    """Lower-case runs of letters and digits. With ``cjk_bigrams``, runs of Chinese characters
    are replaced by their overlapping character pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if not cjk_bigrams:
        return words

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) < 2, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        )

    split_runs = F.regexp_extract_all(F.lower(text), F.lit(CJK + r"+|[\p{L}\p{N}&&[^\u3400-\u9fff]]+"), F.lit(0))
    return F.flatten(F.transform(split_runs, lambda w: F.when(w.rlike("^" + CJK), pairs(w)).otherwise(F.array(w))))


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, trailing blanks off and dots on where something was cut."""
    short = F.regexp_replace(F.left(text, F.lit(limit)), r"\s+$", "")
    return F.when(F.length(text) > limit, F.concat(short, F.lit("..."))).otherwise(text)


def sanitize(text: Column, limit: int = 50_000) -> Column:
    """Strip, salvage JSON, cap, remove control characters."""
    bare = strip(text)
    bare = F.when(bare.startswith("{") | bare.startswith("["), balanced_prefix(bare)).otherwise(bare)
    return F.regexp_replace(capped(bare, limit), CONTROL, "")


def escape_for_log(text: Column, limit: int = 500) -> Column:
    """Backslash, line ends, tabs, NUL and ESC spelled out; other control characters removed;
    longer results end in dots within the limit."""
    out = F.coalesce(text, F.lit("None"))
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x00", "\\0"), ("\x1b", "\\x1b")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(F.length(out) > limit, F.concat(F.left(out, F.lit(limit - 3)), F.lit("..."))).otherwise(out)


def balanced_prefix(text: Column) -> Column:
    """The text up to the last bracket outside strings that closes its kind to zero; unchanged
    when there is none. A fold over the characters that can change the state."""
    marks = F.regexp_extract_all(text, F.lit(r'(?s)\\.|\\|["{}\[\]]|[^\\"{}\[\]]+'), F.lit(0))
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("brace"), zero.alias("bracket"), F.lit(False).alias("quoted"), zero.alias("end"))

    def step(acc: Column, m: Column) -> Column:
        live = ~acc["quoted"]
        at = acc["at"] + F.length(m)
        brace = acc["brace"] + F.when(live & (m == "{"), 1).when(live & (m == "}"), -1).otherwise(0)
        bracket = acc["bracket"] + F.when(live & (m == "["), 1).when(live & (m == "]"), -1).otherwise(0)
        closes = live & (((m == "}") & (brace == 0)) | ((m == "]") & (bracket == 0)))
        return F.struct(
            at.alias("at"), brace.alias("brace"), bracket.alias("bracket"),
            F.when(m == '"', ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            F.when(closes, at).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(marks, start, step, lambda acc: acc["end"])
    return F.when(end > 1, F.substring(text, F.lit(1), end)).otherwise(text)


def salvage_json(text: Column) -> Column:
    """The balanced prefix when it parses, else the stripped text."""
    bare = strip(text)
    cut = balanced_prefix(bare)
    return F.when(F.try_parse_json(cut).isNotNull(), cut).otherwise(bare)


def token_estimate(text: Column) -> Column:
    """A quarter token per ASCII character (whole tokens), one per other character."""
    text = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.floor((F.length(text) - other) / 4) + other
