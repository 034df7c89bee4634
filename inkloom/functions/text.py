"""Text functions as native column expressions.

Java's shorthand classes are ASCII, so that Unicode classes are written out.
Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Unicode-aware white-space matching covers, what a word character is, and invisible characters.
_SPACES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _SPACES) + "]"
_WIDE = "".join(chr(c) for a, b in _SPACES if a > 0x20 for c in range(a, b + 1))
INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060)))
WORD = r"[\p{L}\p{N}_]"
_REF_END = rf"(?!{WORD})"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), rf"^{WS}+|{WS}+$", "")


def collapse_whitespace(column: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(column), f"{WS}+", " "))


def word_tokens(column: Column | str) -> Column:
    """Lower-cased words in order: letters, numbers and underscores of any script."""
    return F.regexp_extract_all(F.lower(collapse_whitespace(column)), F.lit(f"{WORD}+"), F.lit(0))


def word_count(column: Column | str) -> Column:
    """White-space-separated words. Wide spaces become plain ones first: a class of ASCII alone is matched faster."""
    plain = F.translate(_c(column), _WIDE, " " * len(_WIDE))
    return F.regexp_count(plain, F.lit(r"[^\x09-\x0D\x1C-\x20]+"))


def citation_count(column: Column | str) -> Column:
    """Reference tags, those with a name once; attributes may hold no slash. 0 for null."""
    tag = rf"(?is)<ref{_REF_END}([^>/]*?)>(.*?)</ref>|<ref{_REF_END}([^>/]*?)/>"
    tags = F.regexp_extract_all(F.coalesce(_c(column), F.lit("")), F.lit(tag), F.lit(0))
    attributes = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)^<ref([^>/]*)", 1))
    names = F.transform(attributes, lambda a: F.regexp_extract(a, rf"(?i)name{WS}*={WS}*[\"']?([^\"'>\t-\r\x1c-\x20\x85\xa0]+)", 1))
    named = F.array_distinct(F.filter(names, lambda n: n != ""))
    return (F.size(named) + F.size(F.filter(names, lambda n: n == ""))).cast("long")


def reference_tag_count(column: Column | str) -> Column:
    """Every opening or self-closing reference tag: a plain recount, larger where names repeat. 0 for null."""
    return F.regexp_count(F.coalesce(_c(column), F.lit("")), F.lit(rf"(?i)<ref{_REF_END}[^>]*?/?>")).cast("long")


def remove_invisible(column: Column | str) -> Column:
    return F.translate(_c(column), INVISIBLE, "")


def remove_comments(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), r"(?s)<!--.*?-->", "")


def remove_tags_except_ref(column: Column | str) -> Column:
    """Paired tags with their content, then self-closing tags; reference tags stay, and so do unpaired tags."""
    paired = F.regexp_replace(_c(column), rf"(?isu)<(?!ref{_REF_END})([a-zA-Z0-9_:.-]+)({WS}[^>]*)?>.*?</\1>", "")
    return F.regexp_replace(paired, rf"(?is)<(?!ref{_REF_END})[^/>]+?/>", "")


def remove_nested(column: Column | str, opening: str, closing: str) -> Column:
    """Text outside balanced brackets of two characters.

    Tokens are folded with a depth: an unclosed opening swallows the rest, and a
    closing at depth 0 stays.
    """
    a, b = opening, closing
    quote = lambda s: "".join(f"\\{c}" for c in s)
    # single bracket characters are tokens of their own, so that pairs are read from the left
    marks = "".join(f"\\{c}" for c in sorted(set(a + b)))
    tokens = F.regexp_extract_all(_c(column), F.lit(f"(?s){quote(a)}|{quote(b)}|[^{marks}]+|[{marks}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, token: Column) -> Column:
        depth, kept = acc["depth"], acc["kept"]
        inner = F.when(token == a, depth + 1).when((token == b) & (depth > 0), depth - 1).otherwise(depth)
        visible = (depth == 0) & (token != a)
        return F.struct(inner.alias("depth"), F.when(visible, F.concat(kept, F.array(token))).otherwise(kept).alias("kept"))

    return F.aggregate(tokens, start, step, lambda acc: F.array_join(acc["kept"], ""))


def remove_templates(column: Column | str) -> Column:
    return remove_nested(column, "{{", "}}")


def remove_tables(column: Column | str) -> Column:
    return remove_nested(column, "{|", "|}")


def break_sections(column: Column | str) -> Column:
    """Blank lines around headings."""
    return F.regexp_replace(_c(column), rf"(={{2,6}}{WS}*[^=\n]+{WS}*={{2,6}})", "\n\n$1\n\n")


def heading(column: Column | str) -> Column:
    """The heading that a paragraph begins with, or null; its levels must balance."""
    found = F.regexp_extract(_c(column), rf"^{WS}*(={{2,6}}){WS}*([^=\n]+?){WS}*\1", 2)
    return F.when(found == "", None).otherwise(strip(found))


def after_heading(column: Column | str) -> Column:
    return F.when(heading(column).isNull(), _c(column)).otherwise(strip(F.regexp_replace(_c(column), rf"^{WS}*(={{2,6}}){WS}*([^=\n]+?){WS}*\1{WS}*", "")))


def paragraphs(column: Column | str) -> Column:
    """Blocks between blank lines, stripped, blanks within lines collapsed; empty ones included."""
    tidy = F.regexp_replace(F.regexp_replace(_c(column), "\n{2,}", "\n\n"), "[ \t]+", " ")
    return F.transform(F.split(tidy, "\n\n"), strip)


def remove_emphasis(column: Column | str) -> Column:
    return F.replace(F.replace(_c(column), F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))


def link_text(column: Column | str) -> Column:
    """Internal links as their last part."""
    return F.regexp_replace(_c(column), rf"\[\[(?=[^\]])(?:[^\]]*\|)?{WS}*([^\]|]*?){WS}*\]\]", "$1")


def tidy_inline(column: Column | str) -> Column:
    """No-break spaces and blanks as one space; line breaks stay."""
    return strip(F.regexp_replace(F.translate(_c(column), chr(0xA0), " "), r"[ \t\r\f\x0b]+", " "))


# A self-closing reference before a later closing tag is read as an opening one, as the semantics have it.
_REF = rf"(?is)<ref{_REF_END}[^>]*?>.*?</ref{WS}*>|<ref{_REF_END}[^>]*/{WS}*>"


def without_refs(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), _REF, "")


def ref_positions(column: Column | str) -> Column:
    """Places, in the text without reference tags, at which tags stood."""
    pieces = F.split(_c(column), _REF, -1)
    before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.char_length)
    ends = F.aggregate(before, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    return ends


def has_numeric_citation(sentence: Column, right: Column) -> Column:
    """[n] within a sentence, or leading in the text after it."""
    lead = rf"^{WS}*(?:[.!?…]+{WS}*)?(?:\[\p{{Nd}}+\]{WS}*)+"
    return sentence.rlike(r"\[\p{Nd}+\]") | F.substring(right, 1, 32).rlike(lead)


# The punctuation that model inputs keep.
_KEPT = r""".,;:!?"'()\[\]{}\-_/\\"""


def model_text(column: Column | str) -> Column:
    """Letters, numbers, white space and basic punctuation alone; the caller applies NFKC before (see arrow_text.nfkc)."""
    spaced = F.translate(_c(column), chr(0x200B) + chr(0xFEFF), "  ")
    return collapse_whitespace(F.regexp_replace(F.regexp_replace(spaced, f"{WS}", " "), rf"[^\p{{L}}\p{{N}} {_KEPT}]", ""))


def normalized_label(column: Column | str) -> Column:
    """Labels written as words, numbers or booleans, as a string: "0", "1" or the lower-cased text."""
    text = F.lower(strip(_c(column).cast("string")))
    integral = F.regexp_extract(text, r"^([+-]?[0-9]+)\.0+$", 1)
    return (
        F.when(text.isin("0", "false", "neg", "negative", "no"), "0")
        .when(text.isin("1", "true", "pos", "positive", "yes"), "1")
        .when(integral != "", integral)
        .otherwise(text)
    )


def first_present(json: Column | str, keys: list[str]) -> Column:
    """The value of the first key that a JSON object has, even if it is null there."""
    present = F.json_object_keys(_c(json))
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.array_contains(present, key), F.get_json_object(_c(json), f"$.{key}")).otherwise(out)
    return out


def truncated(column: Column | str, most: int) -> Column:
    cut = F.regexp_replace(F.substring(_c(column), 1, most - 3), f"{WS}+$", "")
    return F.when(F.char_length(_c(column)) <= most, _c(column)).otherwise(F.concat(cut, F.lit("...")))


def safe_model_name(column: Column | str, kind: str = "training") -> Column:
    if kind == "training":
        return F.lower(F.translate(_c(column), "/ ", "__"))
    name = F.regexp_replace(F.regexp_replace(_c(column), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(name == "", "model").otherwise(name)


# Phrases by which an answer's label is read when it has no standalone digit.
NEGATIVE_ANSWERS = ("label 0", "khong can kiem chung", "không cần kiểm chứng", "khong check-worthy", "not check-worthy", "opinion", "y kien")
POSITIVE_ANSWERS = ("label 1", "can kiem chung", "cần kiểm chứng", "check-worthy", "factual claim", "co the kiem chung", "có thể kiểm chứng")


def parsed_label(column: Column | str) -> Column:
    """0, 1 or null of a model's answer: a standalone digit, else negative phrases before positive ones."""
    text = F.lower(strip(F.coalesce(_c(column), F.lit(""))))
    digit = F.regexp_extract(text, rf"(?<!{WORD})([01])(?!{WORD})", 1)

    def some(phrases: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for phrase in phrases:
            out = out | text.contains(phrase)
        return out

    return F.when(digit != "", digit.try_cast("int")).when(some(NEGATIVE_ANSWERS), 0).when(some(POSITIVE_ANSWERS), 1)


def shots(mode: str) -> int:
    """k of a prompt mode shot_<k>."""
    head, _, k = mode.partition("shot_")
    if head or not k.isdigit():
        raise ValueError(f"not a prompt mode: {mode}")
    return int(k)
