"""Text functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket pairs, opener then closer.
BRACKETS = (
    "()", "（）", "[]", "【】", "{}", "〔〕", "〈〉", "「」", '""', "＂＂", "''", "“”", "《》", "『』",
    "〝〞", "﹁﹂", "﹃﹄", "⸂⸃", "⸄⸅", "⸉⸊", "⸌⸍", "⸜⸝", "⸠⸡", "‹›", "«»", "＜＞", "<>",
)

# Marks that suggest a horizontal sentence.
HORIZONTAL_MARKS = "。、，？！,.?!…ー〜~"

#: Never part of a text: separates lines before the join rule is applied.
_SEAM = "￿"
_CJK = "[　-鿿]"


def char_class(chars: str) -> str:
    """A regex class of literal characters, valid for Java and RE2."""
    return "[" + "".join("\\" + c if c in r"\[]^-&" else c for c in chars) + "]"


def bracket_class(keep_quotes: bool = False) -> str:
    pairs = [p for p in BRACKETS if not (keep_quotes and p[0] == p[1])]
    return char_class("".join(dict.fromkeys("".join(pairs))))


def _bracket_pattern(keep_quotes: bool = False) -> str:
    """``bracket_class`` split so that a Latin letter is ruled out by one range test."""
    pairs = [p for p in BRACKETS if not (keep_quotes and p[0] == p[1])]
    chars = "".join(dict.fromkeys("".join(pairs)))
    near = "".join(c for c in chars if c < "\u2000")
    far = "".join(c for c in chars if c >= "\u2000")
    return f"(?:{char_class(near)}|[\\x{{2000}}-\\x{{FFFF}}&&{char_class(far)}])"


def strip(text: Column) -> Column:
    """Trim every Unicode space on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def has_brackets(text: Column) -> Column:
    return text.rlike(_bracket_pattern())


def repair_brackets(text: Column, keep_quotes: bool = False) -> Column:
    """Drop unmatched brackets and close every pair with the opener's partner.

    Straight quotes count as openers, so they survive only when another closer
    takes them off the stack; ``keep_quotes`` leaves them alone.  The fold runs
    over the brackets of a text, the text between them is never copied.
    """
    cls = _bracket_pattern(keep_quotes)
    partners = F.create_map(*[F.lit(c) for p in BRACKETS for c in p])
    marks = F.regexp_extract_all(text, F.lit("(" + cls + ")"), F.lit(1))
    openers = F.array(*[F.lit(p[0]) for p in BRACKETS])
    entry = "struct<k:int,c:string>"
    empty = F.array().cast(f"array<{entry}>")
    item = lambda k, c: F.struct(k.cast("int").alias("k"), c.alias("c"))

    def step(state, mark):
        is_open = F.array_contains(openers, mark["c"])
        top = F.element_at(state["stack"], -1)
        closed = F.concat(state["kept"], F.array(top, item(mark["k"], partners[top["c"]])))
        depth = F.size(state["stack"])
        # an opener is pushed, a closer pops; a closer on an empty stack is lost
        stack = (
            F.when(is_open, F.concat(state["stack"], F.array(mark)))
            .when(depth > 0, F.slice(state["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(state["stack"])
        )
        kept = F.when(is_open | (depth == 0), state["kept"]).otherwise(closed)
        return F.struct(stack.alias("stack"), kept.alias("kept"))

    numbered = F.transform(marks, lambda c, k: item(k, c))
    start = F.struct(empty.alias("stack"), empty.alias("kept"))
    kept = F.map_from_entries(F.aggregate(numbered, start, step)["kept"])
    pieces = F.split(text, cls, -1)
    fixed = F.concat(F.transform(marks, lambda c, k: F.coalesce(F.try_element_at(kept, k.cast("int")), F.lit(""))), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(pieces, fixed, lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(cls), whole).otherwise(text)


def join_lines(texts: Column) -> Column:
    """Join ordered lines; no space next to a CJK character, one otherwise."""
    joined = F.array_join(texts, _SEAM)
    tight = F.regexp_replace(joined, f"(?<={_CJK}){_SEAM}+", "")
    tight = F.regexp_replace(tight, f"{_SEAM}(?={_CJK})", "")
    # the patterns look at every character; texts without CJK need none of it
    return F.when(joined.rlike(_CJK), F.replace(tight, F.lit(_SEAM), F.lit(" "))).otherwise(F.array_join(texts, " "))


def has_cjk_edge(text: Column) -> tuple[Column, Column]:
    """Whether the first and the last character are in U+3000..U+9FFF."""
    return text.rlike(f"^{_CJK}"), text.rlike(f"{_CJK}\\z")


def is_valuable(text: Column) -> Column:
    """At least one letter or ideograph."""
    return text.rlike(r"\p{L}")


def looks_horizontal(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    return (F.length(bare) >= 8) | ((F.length(bare) >= 4) & bare.rlike(char_class(HORIZONTAL_MARKS)))


def auto_vertical(text: Column, lines: Column, w: Column, h: Column, forced: Column | None = None) -> Column:
    auto = (
        F.when(looks_horizontal(text), F.lit(False))
        .when((lines > 1) & (F.length(text) >= lines * 3), F.lit(False))
        .otherwise(h > w * 1.35)
    )
    if forced is None:
        return auto
    return F.when(forced == "horizontal", F.lit(False)).when(forced == "vertical", F.lit(True)).otherwise(auto)


def vertical_layout(text: Column) -> Column:
    """One character per row; existing line ends stay, trailing space goes."""
    rows = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"([^\n])", "$1\n")
    return F.regexp_replace(rows, r"(?U)\s+\z", "")


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def data_uri(content: Column, mime: str = "image/png") -> Column:
    code = F.translate(F.base64(content), "\r\n", "")  # base64 may come in lines
    return F.concat(F.lit(f"data:{mime};base64,"), code)


def saturate(v: Column, top: int) -> Column:
    """Truncate to an unsigned integer, clamped to 0..top."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top))).cast("bigint")


def prompt(template: Column, source: Column, target: Column, texts: Column) -> Column:
    out = F.replace(template, F.lit("{source_language}"), source)
    out = F.replace(out, F.lit("{target_language}"), target)
    return F.replace(out, F.lit("{texts}"), texts)


def display_text(translations: Column, text: Column) -> Column:
    """Latest translation, else the one with the smallest key, else the source."""
    latest = F.try_element_at(translations, F.try_element_at(translations, F.lit("last_trans")))
    first = F.try_element_at(translations, F.array_min(F.map_keys(translations)))
    return F.coalesce(latest, first, text)


def output_extension(kind: Column) -> Column:
    """File extension of a renderer; raw, mit and mit.bin all name the binary one."""
    kind = F.lower(kind)
    return (
        F.when(kind.isin("raw", "mit", "mit.bin"), F.lit("mit.bin"))
        .when(kind == "html", F.lit("html")).when(kind == "png", F.lit("png"))
    )


def safe_file_name(name: Column) -> Column:
    return name.rlike(r"^[^/\\]+\z")


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\z")
