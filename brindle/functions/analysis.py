"""Text analysis as columns: char filters, tokenizers and token filters over string and array<string> columns.

Everything but stemming is made of built-in functions, so analysis stays inside the JVM.
"""

from __future__ import annotations

import html.entities
import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import porter

STOP = {
    "_english_": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "_french_": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "_german_": "aber als am an auch auf aus bei bin bis bist da dadurch daher darum das daß dass dein der den des dessen die dies dieser dieses doch dort du durch ein eine einem einen einer eines er es euer für hatte hatten hier ich ihr im in ist ja jede jedem jeden jeder jedes kann mein mit muß nach nein nicht nun oder seid sein sich sie sind soll so über und uns von vor war was weg wenn wer wie wir wird zu zum zur".split(),
    "_spanish_": "al algo como con de del desde donde dos el ella en entre era es esta este ha hasta la las le lo los más me mi mis mucho muy no nos o para pero por que quien se sin sobre su sus también te tiene todo tu un una uno y ya yo".split(),
    "_italian_": "a al alla anche che chi con da dal dalla dei del della di e è gli i il in la le lo ma mi ne nel nella non o per più quella questo se si su sul tra tu un una uno".split(),
    "_portuguese_": "a ao aos as com como da das de do dos e em entre era essa esse esta este eu foi isso mais mas na nas no nos o os ou para pela pelo por que se sem seu sua também te um uma".split(),
    "_dutch_": "aan als bij dat de den der die dit door een en er haar het hij hoe ik in is je kan maar me met mijn naar niet nog nu of om ook op te tot uit van veel voor was wat we wel zo zij".split(),
    "_none_": [],
}
#: letters of the Latin blocks with a mark, and what is left without it
_FOLDED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] < "\x80"} | dict(zip("đłøħıŧĐŁØĦŦ", "dlohitDLOHT", strict=True))
_FOLD_FROM, _FOLD_TO = "".join(_FOLDED), "".join(_FOLDED.values())
WORD = r"[\p{L}\p{N}_]+(?:['’.](?=[\p{L}\p{N}])[\p{L}\p{N}_]+)*"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a column that is evaluated once for each row; a lambda that names a column evaluates it for each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(group + 1 if group else 1))


def _ngrams(word: Column, low: int, high: int, edge: bool) -> Column:
    sizes = F.sequence(F.lit(low), F.lit(high))
    if edge:
        return F.transform(F.filter(sizes, lambda n: n <= F.length(word)), lambda n: F.substring(word, F.lit(1), n))
    starts = F.when(F.length(word) >= low, F.sequence(F.lit(1), F.length(word) - low + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.length(word)), lambda n: F.substring(word, i, n)))
    return F.flatten(grams)


def tokenizer(name: str, c: Column, o: dict[str, Any]) -> Column:
    if name == "standard":
        return _all(c, o.get("pattern", r"[\p{L}\p{N}_]+"))
    if name == "classic":
        return _all(c, r"[\p{L}\p{N}]+(?:[.&'@-][\p{L}\p{N}]+)*")
    if name == "uax_url_email":
        return _all(c, r"https?://[^\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\p{L}\p{N}_]+")
    if name == "whitespace":
        return _all(c, r"[^\s]+")
    if name == "keyword":
        return F.array(c)
    if name == "letter":
        return _all(c, r"\p{L}+")
    if name == "lowercase":
        return _all(F.lower(c), r"\p{L}+")
    if name == "pattern":
        if o.get("group", -1) >= 0:
            return F.regexp_extract_all(c, F.lit(o["pattern"]), F.lit(o["group"]))
        return F.filter(F.split(c, o.get("pattern", r"\W+")), lambda t: t != "")
    if name == "simple_pattern":
        return _all(c, o["pattern"])
    if name in ("simple_pattern_split", "char_group"):
        named = {"whitespace": r"\s", "letter": r"\p{L}", "digit": r"\p{Nd}", "punctuation": r"\p{P}", "symbol": r"\p{S}"}
        cut = o.get("pattern") or "[" + "".join(named.get(x, "\\" + x if not x.isalnum() else x) for x in o["tokenize_on_chars"]) + "]"
        return F.filter(F.split(c, cut), lambda t: t != "")
    if name in ("ngram", "edge_ngram"):
        low, high = o.get("min_gram", 1), o.get("max_gram", 2)
        kinds = {"letter": r"\p{L}", "digit": r"\p{Nd}", "punctuation": r"\p{P}", "symbol": r"\p{S}", "whitespace": r"\s"}
        chars = "".join(kinds[k] for k in o.get("token_chars", []))
        parts = _all(c, f"[{chars}]+") if chars else F.array(c)
        return F.flatten(F.transform(parts, lambda w: _ngrams(w, low, high, name == "edge_ngram")))
    if name == "path_hierarchy":
        d = o.get("delimiter", "/")
        parts = F.split(c, f"\\Q{d}\\E")
        if o.get("reverse"):
            return once(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), d)))
        paths = once(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), d)))
        return F.filter(paths, lambda t: t != "")
    raise ValueError(f"unknown tokenizer {name!r}")


def entities(c: Column) -> Column:
    """Named and numeric character references as their characters; those of `&` last, so that nothing is decoded twice."""
    table = {**html.entities.name2codepoint, "apos": 39, "nbsp": 32}
    chars = F.create_map(*(F.lit(x) for n, p in table.items() for x in (n, chr(p))))
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), 1))

    def value(e: Column) -> Column:
        point = F.when(e.rlike("^#[xX]"), F.conv(F.substr(e, F.lit(3)), 16, 10)).when(e.startswith("#"), F.substr(e, F.lit(2))).cast("long")
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).when(~e.startswith("#"), F.try_element_at(chars, e))

    pairs = F.transform(found, lambda e: F.struct(F.concat(F.lit("&"), e, F.lit(";")).alias("old"), value(e).alias("new")))
    pairs = F.filter(pairs, lambda p: p["new"].isNotNull())
    ordered = F.concat(F.filter(pairs, lambda p: p["new"] != "&"), F.filter(pairs, lambda p: p["new"] == "&"))
    return F.when(c.contains("&"), F.aggregate(ordered, c, lambda s, p: F.replace(s, p["old"], p["new"]))).otherwise(c)


def char_filter(name: str, c: Column, o: dict[str, Any]) -> Column:
    if name == "html_strip":
        c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
        c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table)[^>]*>", "\n")
        c = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")
        return entities(c)
    if name == "mapping":
        for m in o["mappings"]:
            a, _, b = m.partition("=>")
            c = F.replace(c, F.lit(a.strip()), F.lit(b.strip()))
        return c
    if name == "pattern_replace":
        return F.regexp_replace(c, o["pattern"], o.get("replacement", ""))
    raise ValueError(f"unknown char filter {name!r}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _porter(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda x: None if x is None else [None if t is None else porter(t) for t in x])


def _per(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


def _unique(c: Column) -> Column:
    return F.array_distinct(c)


def shingles(c: Column, low: int, high: int, sep: str = " ", unigrams: bool = False) -> Column:
    return once(c, lambda t: _shingles(t, low, high, sep, unigrams))


def _shingles(c: Column, low: int, high: int, sep: str, unigrams: bool) -> Column:
    sizes = [*([1] if unigrams else []), *range(low, high + 1)]
    at = lambda i, n: F.array_join(F.slice(c, i, F.lit(n)), sep)
    every = F.transform(
        F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(F.array().cast("array<int>")),
        lambda i: F.filter(F.array(*(F.when(i + n - 1 <= F.size(c), at(i, n)) for n in sizes)), lambda x: x.isNotNull()),
    )
    return F.flatten(every)


def _common_grams(c: Column, common: list[str]) -> Column:
    pair = lambda i: F.when(F.element_at(c, i).isin(common) | F.element_at(c, i + 1).isin(common), F.concat_ws("_", F.element_at(c, i), F.element_at(c, i + 1)))
    each = F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array(F.element_at(c, i), F.when(i < F.size(c), pair(F.least(i, F.size(c) - 1)))))
    return F.when(F.size(c) > 1, F.filter(F.flatten(each), lambda t: t.isNotNull())).otherwise(c)


def token_filter(name: str, c: Column, o: dict[str, Any]) -> Column:
    if name in ("lowercase", "uppercase"):
        return _per(c, F.lower if name == "lowercase" else F.upper)
    if name == "asciifolding":
        fold = lambda t: F.regexp_replace(F.regexp_replace(F.translate(t, _FOLD_FROM, _FOLD_TO), "ß", "ss"), "æ", "ae")
        return _per(c, fold)
    if name == "stop":
        words = o.get("stopwords", "_english_")
        words = STOP[words] if isinstance(words, str) else words
        return F.filter(c, lambda t: ~(F.lower(t) if o.get("ignore_case") else t).isin(list(words))) if words else c
    if name in ("stemmer", "porter_stem", "snowball", "kstem"):
        return _porter(c)
    if name == "possessive":
        return _per(c, lambda t: F.regexp_replace(t, "['’][sS]$", ""))
    if name == "length":
        return F.filter(c, lambda t: F.length(t).between(o.get("min", 0), o.get("max", 2**31 - 1)))
    if name == "truncate":
        return _per(c, lambda t: F.substring(t, 1, o.get("length", 10)))
    if name == "limit":
        return F.slice(c, 1, o.get("max_token_count", 1))
    if name == "trim":
        return _per(c, F.trim)
    if name == "reverse":
        return _per(c, F.reverse)
    if name == "unique":
        return _unique(c)
    if name == "elision":
        return _per(c, lambda t: F.regexp_replace(t, f"(?i)^({'|'.join(o.get('articles', ['l', 'm', 't', 'qu', 'n', 's', 'j', 'd', 'c']))})['’]", ""))
    if name == "apostrophe":
        return _per(c, lambda t: F.regexp_replace(t, "['’].*$", ""))
    if name == "decimal_digit":
        return _per(c, lambda t: F.translate(t, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3))
    if name == "pattern_replace":
        return _per(c, lambda t: F.regexp_replace(t, o["pattern"], o.get("replacement", "")))
    if name == "pattern_capture":
        caught = lambda t: F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in o["patterns"])))
        keep = o.get("preserve_original", True)
        return F.flatten(_per(c, lambda t: F.array_distinct(F.concat(F.array(t), caught(t)) if keep else caught(t))))
    if name == "keep":
        return F.filter(c, lambda t: t.isin(list(o["keep_words"])))
    if name == "keep_types":
        digits = "<NUM>" in o["types"]
        return F.filter(c, lambda t: t.rlike(r"^\d+$") if digits else ~t.rlike(r"^\d+$"))
    if name == "fingerprint":
        return F.array(F.array_join(F.array_sort(_unique(c)), o.get("separator", " ")))
    if name == "shingle":
        return shingles(c, o.get("min_shingle_size", 2), o.get("max_shingle_size", 2), o.get("token_separator", " "), o.get("output_unigrams", True))
    if name in ("ngram", "edge_ngram"):
        return F.flatten(_per(c, lambda t: _ngrams(t, o.get("min_gram", 1), o.get("max_gram", 2), name == "edge_ngram")))
    if name == "keyword_repeat":
        return F.flatten(_per(c, lambda t: F.array(t, t)))
    if name == "common_grams":
        return once(c, lambda t: _common_grams(t, list(o["common_words"])))
    if name in ("synonym", "synonym_graph"):
        out, table = c, synonyms(o["synonyms"])
        if not table:
            return out
        lookup = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return F.flatten(_per(c, lambda t: F.coalesce(F.try_element_at(lookup, t), F.array(t))))
    if name == "stemmer_override":
        table = dict(r.split("=>") for r in o["rules"])
        lookup = F.create_map(*(F.lit(x.strip()) for kv in table.items() for x in kv))
        return _per(c, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    if name in ("word_delimiter", "word_delimiter_graph"):
        parts = lambda t: _all(t, r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+")
        return F.flatten(_per(c, lambda t: F.array_distinct(F.concat(F.array(t), parts(t))) if o.get("preserve_original") else parts(t)))
    if name == "phonetic":
        return _per(c, F.soundex)
    if name == "multiplexer":
        return F.flatten(_per(c, lambda t: F.array_distinct(F.concat(*([F.array(t)] if o.get("preserve_original", True) else []), *(_chain(F.array(t), f.split(",")) for f in o["filters"])))))
    if name in ("delimited_payload", "delimited_term_freq"):
        return _per(c, lambda t: F.substring_index(t, o.get("delimiter", "|"), 1))
    if name == "min_hash":
        n = o.get("hash_count", 1) * o.get("bucket_count", 512)
        return F.slice(F.array_sort(_per(_unique(c), lambda t: F.hex(F.xxhash64(t)))), 1, n)
    if name == "cjk_bigram":
        return F.flatten(_per(c, lambda t: F.when(t.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$"), _ngrams(t, 2, 2, False)).otherwise(F.array(t))))
    if name == "cjk_width":
        wide = "".join(chr(0xFF01 + i) for i in range(94))
        return _per(c, lambda t: F.translate(t, wide, "".join(chr(0x21 + i) for i in range(94))))
    if name == "german_normalization":
        return _per(c, lambda t: F.regexp_replace(F.translate(t, "äöüÄÖÜ", "aouAOU"), "ß", "ss"))
    raise ValueError(f"unknown token filter {name!r}")


def _chain(c: Column, names: list[str]) -> Column:
    for n in names:
        c = token_filter(n.strip(), c, {})
    return c


def synonyms(rules: list[str]) -> dict[str, list[str]]:
    """`a, b` makes equivalents, `a, b => c` replaces."""
    out: dict[str, list[str]] = {}
    for rule in rules:
        left, arrow, right = rule.partition("=>")
        a = [x.strip() for x in left.split(",") if x.strip()]
        b = [x.strip() for x in right.split(",") if x.strip()] if arrow else a
        for x in a:
            out[x] = [*out.get(x, []), *(y for y in b if y not in out.get(x, []))]
    return out


_LANG = {"english": "_english_", "french": "_french_", "german": "_german_", "spanish": "_spanish_", "italian": "_italian_", "portuguese": "_portuguese_", "dutch": "_dutch_"}


class Analyzers:
    """Named chains: the built-in ones and those of an index's settings (`analysis` JSON)."""

    def __init__(self, settings: dict[str, Any] | None = None):
        self.settings = settings or {}

    def _part(self, kind: str, name: str | dict) -> tuple[str, dict[str, Any]]:
        if isinstance(name, dict):
            return name["type"], name
        own = self.settings.get(kind, {}).get(name)
        return (own["type"], own) if own else (name, {})

    def tokens(self, c: Column, name: str | dict = "standard") -> Column:
        own = name if isinstance(name, dict) else self.settings.get("analyzer", {}).get(name)
        if own and own.get("type", "custom") == "custom":
            for f in own.get("char_filter", []):
                c = char_filter(*self._with(c, "char_filter", f))
            out = tokenizer(*self._with(c, "tokenizer", own.get("tokenizer", "standard")))
            for f in own.get("filter", []):
                out = token_filter(*self._with(out, "filter", f))
            return out
        if own:
            name, o = own["type"], own
        else:
            o = {}
        c = F.coalesce(c, F.lit(""))
        low = lambda x: token_filter("lowercase", x, {})
        if name == "standard":
            return token_filter("stop", tokenizer("standard", F.lower(c), o), {"stopwords": o.get("stopwords", "_none_")})
        if name == "simple":
            return tokenizer("lowercase", c, o)
        if name == "whitespace":
            return tokenizer("whitespace", c, o)
        if name == "stop":
            return token_filter("stop", tokenizer("lowercase", c, o), o)
        if name == "keyword":
            return F.array(c)
        if name == "pattern":
            return tokenizer("pattern", F.lower(c), o)
        if name == "fingerprint":
            return token_filter("fingerprint", token_filter("asciifolding", low(tokenizer("standard", c, o)), {}), o)
        if name in ("english", "snowball"):
            out = token_filter("possessive", tokenizer("standard", c, {"pattern": WORD}), {})
            return _porter(token_filter("stop", low(out), {"stopwords": o.get("stopwords", "_english_")}))
        if name in _LANG:
            out = low(tokenizer("standard", c, {"pattern": WORD}))
            out = token_filter("elision", out, {}) if name in ("french", "italian") else out
            out = token_filter("stop", out, {"stopwords": _LANG[name]})
            return token_filter("german_normalization", out, {}) if name == "german" else out
        if name == "cjk":
            return token_filter("cjk_bigram", low(token_filter("cjk_width", tokenizer("standard", c, o), {})), {})
        raise ValueError(f"unknown analyzer {name!r}")

    def _with(self, c: Column, kind: str, part: str | dict) -> tuple[str, Column, dict[str, Any]]:
        name, o = self._part(kind, part)
        return name, c, o

    def analyze(self, spark, text: str, name: str | dict = "standard") -> list[str]:
        """Tokens of one text, for queries."""
        return spark.range(1).select(self.tokens(F.lit(text), name).alias("t")).first()[0]
