"""Text functions that need Python: Unicode normal forms and long or deeply nested markup.

All are Arrow functions over parts of a batch: a batch is bounded in rows and
bytes by the session, and of it only a part's texts are Python strings at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import INVISIBLE

# Prefixes of file and image links.
FILE_PREFIXES = ("Tập tin:", "Tập_tin:", "File:")


#: Bytes of text that are Python strings at once in a worker; a longer text is a part of its own.
PART_BYTES = 1 << 20


def parts_of(values: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """values in slices that end where another `most` bytes begin, so that none exceeds them by more than a value."""
    filled = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    ends = [*(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(values)]
    for begin, end in zip([0, *ends], ends):
        yield values.slice(begin, end - begin)


def each(function: Callable[[str], str]):
    """An Arrow function of the text function; null gives null."""

    @F.arrow_udf(StringType())
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts_of(batch):
                yield pa.array([None if t is None else function(t) for t in part.to_pylist()], pa.string())
            del batch, part  # before the next batch is read

    return mapped


nfc = each(lambda t: unicodedata.normalize("NFC", t))
nfkc = each(lambda t: unicodedata.normalize("NFKC", t))


def outside(text: str, opening: str, closing: str) -> str:
    """Text outside balanced brackets: one pass over the bracket tokens, however long the text."""
    kept, depth, last = [], 0, 0
    for mark in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if mark.group() == closing and not depth:
            continue
        if not depth:
            kept.append(text[last : mark.start()])
        depth += 1 if mark.group() == opening else -1
        last = mark.end()
    return "".join(kept) if depth else "".join(kept) + text[last:]


def file_blocks(text: str, prefixes: tuple[str, ...] = FILE_PREFIXES) -> tuple[str, list[str]]:
    """(text without file links, the links). Links nest; an unclosed one takes the rest with it."""
    begin = re.compile(r"\[\[(?=" + "|".join(map(re.escape, prefixes)) + ")")
    either = re.compile(r"\[\[|\]\]")
    kept, blocks, at = [], [], 0
    while start := begin.search(text, at):
        kept.append(text[at : start.start()])
        depth, at = 1, start.end()
        while depth and (mark := either.search(text, at)):
            depth += 1 if mark.group() == "[[" else -1
            at = mark.end()
        if depth:
            return "".join(kept), blocks
        blocks.append(text[start.start() : at])
    return "".join(kept) + text[at:], blocks


without_files = each(lambda t: file_blocks(t)[0])


_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_PAIRED = re.compile(r"<(?!ref\b)([a-zA-Z0-9_:.-]+)(\s[^>]*)?>.*?</\1>", re.DOTALL | re.IGNORECASE)
_CLOSED = re.compile(r"<(?!ref\b)[^/>]+?/>", re.DOTALL | re.IGNORECASE)
_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))


def stripped_markup(text: str) -> str:
    """Markup chain of long texts: normal form, invisible characters, comments, tags but references, templates, tables."""
    text = unicodedata.normalize("NFC", text).translate(_INVISIBLE)
    text = _CLOSED.sub("", _PAIRED.sub("", _COMMENT.sub("", text)))
    return outside(outside(text, "{{", "}}"), "{|", "|}")


strip_markup = each(stripped_markup)

_SECTION = re.compile(r"(={2,6}\s*[^=\n]+\s*={2,6})")


def page_text(text: str) -> str:
    """stripped_markup(), blank lines around headings as in break_sections(), and no file links: one pass of a worker."""
    return file_blocks(_SECTION.sub(r"\n\n\1\n\n", stripped_markup(text)))[0]


stripped_page = each(page_text)

# remove_templates() and remove_tables() in time linear in the text, for whole pages.
without_templates = each(lambda t: outside(t, "{{", "}}"))
without_tables = each(lambda t: outside(t, "{|", "|}"))


_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_REFERENCE = re.compile(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_HEADING = re.compile(r"^\s*={2,6}\s*(.*?)\s*={2,6}\s*$", re.MULTILINE)
_LIST = re.compile(r"^[*#:;]+\s*", re.MULTILINE)
_SPACE = re.compile(r"\s+")


def plain_text(text: str) -> str:
    """Readable text of a page: all markup gone, links and headings as their text, one space between words.

    An own rule set; parsers of the markup's full grammar give slightly different texts.
    """
    text = outside(outside(_REFERENCE.sub("", _COMMENT.sub("", text)), "{{", "}}"), "{|", "|}")
    text = file_blocks(text)[0]
    while (linked := _LINK.sub(r"\1", text)) != text:
        text = linked
    text = _LIST.sub("", _HEADING.sub(r"\1", _TAG.sub("", _EXTERNAL.sub(r"\1", text))))
    return _SPACE.sub(" ", text.replace("'''", "").replace("''", "")).strip()


normalized_text = each(plain_text)
