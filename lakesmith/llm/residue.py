"""Template residue, filler, error pages and script notices in the place of content.

One multi-pattern automaton holds the phrases of all languages. A text is read once through it, as plain words between
single spaces; it is a case when what the matches cover is most of the document. Covered are the letters of phrases that
stand for residue, and beside them those of what such notices say besides (`to continue`, `in your browser`), which count
only where a phrase was found. Stand-in words are patterns of the same automaton, and a text of nothing but them is filler.

Not everything is a phrase. Two things are measured beside the automaton: placeholders, whose names are free, by their
notation, with the whole notation counting as covered; and meaningless letters or words, by what no text of a language
lacks (a variety of letters, function words).

What counts on neither side of the share: tags, page furniture (the lines around a post), numbers and hexadecimal ids.
What is quoted (indented, fenced, in backticks or quotation marks) is content, unless the text says nothing around it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.llm import phrases
from lakesmith.plans.shipping import ship

#: A text is a case when residue makes up at least this share of its letters; for stand-in words, which are words of posts as well, it is more.
COVERAGE = 0.6
FILLER_COVERAGE = 0.85

#: Of what is covered, at least this share of all letters must be phrases or placeholders themselves.
CORE = 0.25

#: A text of so many letters has more than so many different ones; one of so many words of letters alone has a function word.
FEW_LETTERS = ((12, 2), (24, 8))
MANY_WORDS = 16

# Frequent words of two letters or more, without which texts of the languages do not get along.
FUNCTION_WORDS = frozenset(
    "the to of and is in it you for that this on are not with be if de la el que en los las por para un una le les et des est pas pour dans der die und das ist ein nicht den von zu mit auf em um não os uma da il di che è per sono het een van niet op nie na jest się do i w och att det som är för på inte".split()
) - {"do", "i", "w", "un"}

PHRASE, CONTEXT, WORD = 1, 2, 4

#: Notations of placeholders.
PLACEHOLDERS = re.compile(
    r"\{\{\{?[^{}\n]*\}?\}\}|\{%[^%\n]*%\}|\$\{[^{}\n]*\}|#\{[^{}\n]*\}|\{[0-9]{1,3}\}|%%[\w .-]+%%|%\([\w .-]+\)[sd]|<%[=-]?[^%\n]*%>|\[\[[\w .:-]+\]\]|@@[\w .-]+@@|\b__[A-Z][A-Z0-9_ ]*__\b"
    r"|<(?:your|insert|enter|add)\b[^<>\n]+>|\[(?:your|insert|enter|add)\b[^\[\]\n]+\]|\[[A-Z][A-Z0-9_. ]+\]|\{[a-z]+_[a-z_]+\}|%[A-Z_]{3,}%"
)

#: Page furniture, as whole lines.
FURNITURE = re.compile(
    r"^\W*(?:[\w.-]+ board|(?:home|questions|tags|users|about|help|contact|faq|imprint|login|register)(?: *[|>»·/] *[\w ]+)+|(?:ref|reference|ray|request|trace|incident)[ .:#]*(?:id[ :]*)?[0-9a-f-]{3,}\.?|(?:©|\(c\)|copyright)\W.*"
    r"|(?:accepted )?answers? \(\d+ votes?\)|(?:asked|answered|edited|posted|viewed|active|modified)\b.*(?:ago|times|today|yesterday)|\d+ (?:comments?|votes?|answers?|views?)|\d+ (?:of|/) \d+|share|reply|report|log ?in|sign up|search|menu"
    r"|[\w.-]+/\d+(?:\.\d+)+|(?:server|date|via|etag|connection|location|retry-after|cache-control|set-cookie|x-[\w-]+|content-[\w-]+): .*)\W*$", re.IGNORECASE
)

#: Lines of a stack trace, which belong to the error that they follow.
FRAME = re.compile(r"^(?:at \S.*[:(]\d+\)?|file \".*\", line \d+.*|.* on line \d+\.?)$")

_TAG = re.compile(r"</?(?!(?:your|insert|enter|add)\b)[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<!doctype[^<>]*>", re.IGNORECASE)
_CODE_TAG = re.compile(r"<(pre|code|blockquote)\b[^<>]*>", re.IGNORECASE)
_CODE_END = {name: re.compile(f"</{name}>", re.IGNORECASE) for name in ("pre", "code", "blockquote")}
#: An error as XML says in its tags what it is.
_ERROR_XML = re.compile(r"<error>\s*<code>(\w+)</code>", re.IGNORECASE)
_FENCE = re.compile(r"^(`{3,}|~{3,}).*?(?:^\1|\Z)", re.MULTILINE | re.DOTALL)
_INDENTED = re.compile(r"^(?: {4}|\t|>).*$", re.MULTILINE)
_QUOTED = re.compile(r"`[^`\n]+`|\"[^\"\n]+\"|“[^”\n]+”|„[^“\n]+“|«[^»\n]+»|(?<!\w)'[^'\n]{2,}'(?!\w)|「[^」\n]+」")
_QUOTE_MARKS = re.compile(r"^(?: {4}|\t|> ?)|`{3,}|~{3,}", re.MULTILINE)
#: Hexadecimal ids, names with a version and numbers with what is glued to them.
_NEUTRAL = re.compile(r"(?<![\w-])(?=[a-f-]*+[0-9])[0-9a-f][0-9a-f-]{5,}\b|(?<![\w-])[\w-]++/\d+(?:\.\d+)+\b")
#: Some sign of each notation.
_OPENINGS = ("{", "%", "[", "@@", "__", "<")
_APART = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_DIGITS = "0123456789"
_ONLY_WORDS = re.compile(r"[^\W\d_]+(?:[\s.,!?]+[^\W\d_]+)*[\s.,!?]*")


def _words(text: str) -> str:
    """A text as lower-case words between single spaces, with one before and behind."""
    return f" {_APART.sub(' ', text.lower()).strip()} "


def _letters(words: str) -> int:
    """How many letters some words (as `_words` gives them) have."""
    return len(words) - words.count(" ") - sum(map(words.count, _DIGITS))


def _pattern(phrase: str) -> str:
    """A phrase as it stands in `_words` of a text; scripts that do not set words apart match anywhere, a `*` leaves the end open."""
    plain = _words(unicodedata.normalize("NFKC", phrase))
    if "぀" <= max(plain) <= "￯":
        return plain.strip()
    return plain.rstrip() if phrase.endswith("*") else plain


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All patterns; a match gives its length and kinds."""
    kinds: dict[str, int] = {}
    for kind, source in ((PHRASE, phrases.phrases()), (CONTEXT, phrases.CONTEXT_PHRASES), (WORD, (*phrases.FILLER_WORDS, *phrases.KEYED_WORDS))):
        for phrase in source:
            kinds[_pattern(phrase)] = kinds.get(_pattern(phrase), 0) | kind
    machine = ahocorasick.Automaton()
    for pattern, kind in kinds.items():
        machine.add_word(pattern, (len(pattern), kind))
    machine.make_automaton()
    return machine


def _covered(words: str, spans: list[tuple[int, int]]) -> int:
    """Letters in the union of some spans."""
    total, reach = 0, 0
    for start, stop in sorted(spans):
        if stop > reach:
            total += _letters(words[max(start, reach) : stop])
            reach = stop
    return total


def _share(body: str, words: str, marks: int, beside: int = 0) -> float:
    """The share of residue in a body, given as its words too, `marks` signs of placeholders, and `beside` letters of content; stand-in words alone count in full."""
    spans: dict[int, list[tuple[int, int]]] = {PHRASE: [], CONTEXT: [], WORD: []}
    for last, (size, kinds) in automaton().iter(words):
        for kind, own in spans.items():
            if kinds & kind:
                own.append((last + 1 - size, last + 1))
    if not (marks or spans[PHRASE] or spans[WORD]):
        return 0.0
    total = _letters(words)
    at_most = sum(stop - start for start, stop in spans[WORD] + spans[PHRASE])
    if not (marks or spans[PHRASE]) and at_most < FILLER_COVERAGE * (total - sum(map(len, _NEUTRAL.findall(body)))):
        return 0.0
    total += beside - sum(_letters(_words(x)) for x in _NEUTRAL.findall(body))
    if total <= 0:
        return 1.0 if marks or spans[PHRASE] else 0.0
    core = marks + _covered(words, spans[PHRASE])
    share = 0.0
    if core >= CORE * (total + marks):
        share = (marks + _covered(words, spans[PHRASE] + spans[CONTEXT])) / (total + marks)
    if share < 1 and spans[WORD] and at_most >= FILLER_COVERAGE * total and _covered(words, spans[WORD] + spans[PHRASE]) >= FILLER_COVERAGE * total:
        return 1.0
    return share


def _without_comments(text: str) -> str:
    """A text without its closed comments."""
    kept, i = [], 0
    while (start := text.find("<!--", i)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        kept.append(text[i:start])
        i = stop + 3
    return "\n".join([*kept, text[i:]])


def _without_code(text: str, quotes: list[str]) -> str:
    """A text without what stands between code tags, which goes to `quotes`; a tag that is never closed is no quotation."""
    kept, i, open_ended = [], 0, set()
    for tag in _CODE_TAG.finditer(text):
        name = tag.group(1).lower()
        if tag.start() < i or name in open_ended:
            continue
        end = _CODE_END[name].search(text, tag.end())
        if end is None:
            open_ended.add(name)
            continue
        quotes.append(text[tag.start() : end.end()])
        kept.append(text[i : tag.start()])
        i = end.end()
    return " ".join([*kept, text[i:]])


def _label(text: str, reach: int, start: int) -> int:
    """Where the label of a placeholder begins, a name with a colon or an equals sign before it; its own start if it has none."""
    i = start
    while i > reach and text[i - 1] in " \t":
        i -= 1
    if i == reach or text[i - 1] not in "=:":
        return start
    i -= 1
    while i > reach and text[i - 1] in " \t":
        i -= 1
    j = i
    while j > reach and (text[j - 1].isalnum() or text[j - 1] in "_.-"):
        j -= 1
    return j if j < i else start


def is_meaningless(text: str) -> bool:
    """Whether a text consists of too few different letters, or of many words among which no language has a function word."""
    if not text.isascii():
        return False
    distinct = sum(map(str.isalpha, set(text)))
    if distinct <= max(most for _, most in FEW_LETTERS) and any(len(_LETTER.findall(text)) >= n and distinct <= most for n, most in FEW_LETTERS):
        return True
    if _ONLY_WORDS.fullmatch(text.strip()) is None:
        return False
    words = text.split()
    return len(words) >= MANY_WORDS and FUNCTION_WORDS.isdisjoint(w.strip(".,!?") for w in words)


def _body(text: str) -> str:
    """A text without tags (which are gone already) and furniture; the frames of a stack trace become words of their own kind."""
    lines = (line.strip() for line in text.split("\n"))
    return "\n".join("traceback" if FRAME.match(line.lower()) else line for line in lines if line and not FURNITURE.match(line))


def coverage(text: str | None) -> float:
    """The share of residue in a text, in [0, 1]; 0 for NULL, empty and blank texts, and where only furniture stands."""
    if not text or text.isspace():
        return 0.0
    plain = unicodedata.normalize("NFKC", html.unescape(text)).replace("’", "'").replace("‘", "'").replace("\r\n", "\n").replace("\r", "\n")
    quotes: list[str] = []

    def quoted(match: re.Match) -> str:
        quotes.append(match.group())
        return " "

    def marked(part: str) -> tuple[str, int]:
        if not any(map(part.__contains__, _OPENINGS)):
            return part, 0
        signs, kept, reach = 0, [], 0
        for match in PLACEHOLDERS.finditer(part):
            start, stop = match.span()
            start = _label(part, reach, start)
            signs += stop - start - part.count(" ", start, stop)
            kept.append(part[reach:start])
            reach = stop
        return " ".join([*kept, part[reach:]]), signs

    outside = plain = _ERROR_XML.sub(r" error code \1 ", plain)
    # Tags go before quotation marks are looked for, as their attributes stand in some.
    if "<" in outside:
        outside = plain = _without_comments(plain)
        outside = _TAG.sub("\n", _without_code(outside, quotes))
    for quotation in (_FENCE, _INDENTED, _QUOTED):
        outside = quotation.sub(quoted, outside)
    outside, marks = marked(outside)
    body = _body(outside)
    words = _words(body)
    if quotes and (marks or _LETTER.search(words)):
        # Quotations are content beside what is said around them.
        return _share(body.lower(), words, marks, sum(_letters(_words(q)) for q in quotes))
    if quotes:
        outside, marks = marked(_QUOTED.sub(lambda m: m.group()[1:-1], _QUOTE_MARKS.sub("", _TAG.sub("\n", plain))))
        body = _body(outside)
        words = _words(body)
    share = _share(body.lower(), words, marks)
    return 1.0 if share < 1 and not marks and is_meaningless(body.lower()) else share


def is_residue(text: str | None, threshold: float = COVERAGE) -> bool:
    return coverage(text) >= threshold


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = COVERAGE) -> DataFrame:
    """(key, is_residue): one row per document. NULL, empty and blank texts are no cases; repeated and NULL keys stay as they are."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [is_residue(value.as_py(), threshold) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["k", "is_residue"])

    source = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, is_residue boolean").withColumnRenamed("k", key)


def clean_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = COVERAGE) -> DataFrame:
    """The documents without the cases, in their own columns; rows with a NULL key stay unless their own text is a case.

    The flag is computed beside the row in one pass, so nothing is joined and extra columns cannot clash.
    """
    ship(documents.sparkSession)
    columns, flag = documents.columns, "__is_residue"
    keep = F.pandas_udf(lambda texts: texts.map(lambda t: not is_residue(t, threshold)), "boolean")
    return documents.withColumn(flag, keep(F.col(f"`{text}`").cast("string"))).filter(F.col(flag)).select(*(F.col(f"`{c}`") for c in columns))
