"""Text functions: tokens and stems, HTML to text, abstracts, slugs, ids, digests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "is", "it", "by", "with", "as", "be", "was", "are",
    "been", "from", "has", "had", "have", "that", "this", "not", "no", "will", "can", "all", "its", "than", "into", "also", "may",
    "such", "when", "which", "where", "who", "how", "what", "would", "could", "should", "about", "over", "between", "through",
    "after", "before", "during", "under", "above",
]


def _accented() -> tuple[str, str]:
    """Lower-case letters that are a letter of a-z or a digit and combining marks, and those letters; by Unicode's canonical decomposition."""
    marks = range(0x300, 0x370)
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    plain = {c: d[0] for c, d in parts.items() if d[0].isascii() and d[0].isalnum() and d[0].islower() and len(d) > 1 and all(ord(m) in marks for m in d[1:])}
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accented()
#: Combining marks, which go.
MARKS = "".join(map(chr, range(0x300, 0x370)))

# The endings of a word, by step. Of a step's endings the longest that fits goes; what its groups hold, or what stands
# beside it, stays.
PLURAL = "^(?:(..+i)es|(.*ss)es|(..+[^s])s)$"
TENSE = "^(?:(..+ee)d|(?!.*eed$)(.*[aeiou].*)ed|(.*[aeiou].*)ing)$"
LAST_Y = "(?<=.[^aeiou])y$"
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
FORMED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
SUFFIX = "^(?:(..+?)(?:ement|ment|ent|ant|ence|ance|ible|able|er|ou)|(.+[st])ion)$"
DOUBLE_L = "(?<=..l)l$"


_PLURAL, _TENSE, _LAST_Y, _SUFFIX, _DOUBLE_L = map(re.compile, (PLURAL, TENSE, LAST_Y, SUFFIX, DOUBLE_L))
_DERIVED, _FORMED = (re.compile(f"({'|'.join(table)})$") for table in (DERIVED, FORMED))


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """A word without its endings, step by step; most words' last letters rule a step out."""
    kept = lambda m: "".join(g for g in m.groups() if g)
    if word.endswith("s"):
        word = _PLURAL.sub(kept, word)
    if word.endswith(("d", "g")):
        word = _TENSE.sub(kept, word)
    if word.endswith("y"):
        word = _LAST_Y.sub("i", word)
    word = _DERIVED.sub(lambda m: DERIVED[m[1]], word, count=1)
    word = _FORMED.sub(lambda m: FORMED[m[1]], word, count=1)
    if word.endswith(("t", "e", "r", "u", "n")):
        word = _SUFFIX.sub(kept, word)
    return _DOUBLE_L.sub("", word)


def stems(words: Column) -> Column:
    """Distinct stems of 2 to 40 characters of an array of words, in order of first use. Of an Arrow batch each different word is stemmed
    once, and a worker remembers some 262,000 words."""

    @F.arrow_udf("array<string>")
    def stemmed(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        stems = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), stems.take(coded.indices))

    return F.array_distinct(F.filter(stemmed(F.array_distinct(words)), lambda w: F.length(w).between(2, 40)))


def words(text: Column) -> Column:
    """Lower-case words of 2 to 40 letters and digits that are no stop words, accents and combining marks taken off;
    repeats stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, ACCENTED + MARKS, PLAIN)).otherwise(low), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t).between(2, 40) & ~t.isin(STOP_WORDS))


_WORD = re.compile("[a-z0-9]{2,}")
_MARK = re.compile("[\u0300-\u036f]+")
_STOP = frozenset(STOP_WORDS)


def terms_of(text: str | None) -> list[str]:
    """The distinct stems of the words of a text."""
    low = (text or "").lower()
    if not low.isascii():
        low = _MARK.sub("", unicodedata.normalize("NFD", low))
    found = dict.fromkeys(stem(w) for w in dict.fromkeys(_WORD.findall(low)) if len(w) <= 40 and w not in _STOP)
    return [t for t in found if 2 <= len(t) <= 40]


def terms(text: Column) -> Column:
    """stems(words(text)) in one step."""

    @F.arrow_udf("array<string>")
    def each(texts: pa.Array) -> pa.Array:
        return pa.array([terms_of(t.as_py()) for t in texts], pa.list_(pa.string()))

    return each(text)


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A text after the replacements of all rules, one after another."""
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, text)


# Parts of a page that are no content, then what becomes of headings and paragraphs, in this order, and entities.
DROPPED_TAGS = ["script", "style", "nav", "header", "footer"]
CONTENT = [
    (r"(?is)<(?:h[1-6]|span|div)[^>]*class=[^>]*ltx_title[^>]*>\s*(.*?)\s*</(?:h[1-6]|span|div)>", "\n## $1\n"),
    *((rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h[1-6]>", "\n" + "#" * n + " $1\n") for n in range(1, 7)),
    (r"(?is)<(?:p|div)[^>]*class=[^>]*ltx_p[^>]*>\s*(.*?)\s*</(?:p|div)>", "$1\n\n"),
    (r"(?is)<p(?:\s[^>]*)?>\s*(.*?)\s*</p>", "$1\n\n"),
    ("<[^>]+>", " "),
]
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


def main_content(html: Column) -> Column:
    """The text of a page: no scripts, styles, navigation, headers or footers; headings as #, titles of papers as ##; paragraphs apart;
    entities resolved. Pages are read whole."""
    out = replaced(html, [*((f"(?is)<{tag}.*?</{tag}>", "") for tag in DROPPED_TAGS), *CONTENT])
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, "\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^#{2,3}\s+\S"))


def content_class(text: Column) -> Column:
    """By bytes and sections: enough for a full text, for a part, or neither."""
    n = F.octet_length(text)
    return F.when((n >= 1000) & (section_count(text) >= 2), "SUCCESS").when(n >= 200, "PARTIAL").otherwise("SKIP")


#: The first block between two lines of dashes, with what follows it.
FRONT_MATTER = r"(?ms)^---.*?---\s*(.*)\z"
# What an abstract loses, in this order, and what stands in its place.
MARKUP = [
    ("```[\\s\\S]*?```", ""),  # code
    ("<[^>]+>", " "),  # tags
    (r"!\[[^\]]*\]\([^)]+\)", ""),  # images
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),  # links
    (r"[#*`\[\]]", ""),  # signs
    (r"\s+", " "),
]


def clean_abstract(body: Column, size: int = 500) -> Column:
    """The first `size` characters of a text without its front matter and markup; later blocks between dashes stay."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), FRONT_MATTER, "$1")
    return F.substring(F.trim(replaced(text, MARKUP)), 1, size)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def humanise(name: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[-_]+", " ")))


def repair_json(text: Column) -> Column:
    """A backslash before a character that JSON doesn't escape is doubled."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def front_matter(text: Column) -> Column:
    """The `key: value` lines between two --- lines at the start, as a map."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def sections(text: Column) -> Column:
    """The parts below `## ` headings, by heading."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n##\s+"), 2, 1000)
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "\n", 1)), F.btrim(F.regexp_replace(x, r"^[^\n]*\n?", ""), F.lit(" \t\r\n")))))


def richer(a: Column, b: Column) -> Column:
    """The text with more bytes, the second one of equals."""
    return F.when(F.octet_length(a) > F.octet_length(b), a).otherwise(b)


# What citations and descriptions lose, in this order, and what stands in its place.
CITATION_NOISE = [(r"\{\s*,", "{"), (r"\s+", " ")]
DESCRIPTION_NOISE = [(r"^\s*---\s*[\s\S]*?---\s*", ""), ("<[^>]*>?", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[(.*?)\]\(.*?\)", "$1"), (r"https?://[^\s]{30,}", ""), ("(?i)!GitHub repo size|!Harbor Ko-fi", ""), (r"\s+", " ")]


def clean_citation(text: Column, mark: str) -> Column:
    """A citation without a catalogue's own keys, which stand in brackets and begin with `mark` and a dash, whatever its case."""
    return F.trim(replaced(text, [(rf"(?i)\[{re.escape(mark)}-[^\]]*\]", ""), *CITATION_NOISE]))


def clean_description(text: Column) -> Column:
    return F.trim(replaced(text, DESCRIPTION_NOISE))


def dataset_refs(text: Column) -> Column:
    """Data sets that a text names: the first of a `datasets:` list and those of addresses, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"datasets:\s*([A-Za-z0-9_.-]+)"), 1), F.regexp_extract_all(text, F.lit(r"huggingface\.co/datasets/([A-Za-z0-9_./-]*[A-Za-z0-9])"), 1)))


def base_model_ref(text: Column) -> Column:
    return F.regexp_extract(text, r"base_model:\s*([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1)


def xml_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def short_id(id: Column) -> Column:
    """Sixteen hex digits of the id's SHA-256."""
    return F.substring(F.sha2(id, 256), 1, 16)


def edge_id(src: Column, verb: Column, dst: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", src, verb, dst), 256), 1, 16)


def assertion_id(a: Column, b: Column, method: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", a, b, method), 256), 1, 32)


def hex_slot(digest: Column, slots: int) -> Column:
    """A slot from the first 32 bits of a hex digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def xxh64_slot(slots: int):
    """A pandas UDF: XXH64 with seed 0 of a string, mod slots; Spark's own function fixes another seed."""

    @F.pandas_udf("int")
    def slot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for b in batches:
            yield b.map(lambda x: None if x is None else xxhash.xxh64_intdigest(x, 0) % slots).astype("Int32")

    return slot
