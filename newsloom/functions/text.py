"""Scalar text functions over columns. They stay in the JVM, but for decomposing letters that are not ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that carry no content, for the canonical and for the review key.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "referrer", "fbclid", "gclid", "msclkid", "_ga", "source",
    "from", "via", "share", "s", "cmpid", "mod",
]
REVIEW_TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "utm"]
# Schemes whose URLs have an authority even where it is empty.
WITH_AUTHORITY = ["ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
EMPTY = ["", "nan", "null", "none", "n/a", "na"]
#: What a word is made of, and a character that is none, as in word boundaries of any script.
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row: a lambda's variable is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://"))


def authority(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def url_path(url: Column) -> Column:
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def url_query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def unquoted(text: Column) -> Column:
    """Percent codes and + decoded; a text with malformed codes keeps them."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def quoted(text: Column) -> Column:
    """Percent-encoded with + for a space; letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parsed(url: Column, body) -> Column:
    """body(scheme, authority, path, parameters) of a trimmed URL, also of one without scheme or authority; parameters
    are structs of decoded names and values, in order."""
    clean = F.regexp_replace(trimmed(url), r"[\t\r\n]", "")
    kind = F.lower(_part(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):"))
    rest = F.regexp_replace(F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "(?s)#.*$", "")
    host = F.lower(_part(rest, r"^//([^/?]*)"))
    path = _part(F.regexp_replace(rest, r"^//[^/?]*", ""), r"(?s)^([^?]*)")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        return F.struct(unquoted(F.when(at > 0, F.left(p, at - 1)).otherwise(p)).alias("k"), unquoted(F.when(at > 0, F.substr(p, at + 1)).otherwise("")).alias("v"))

    query = F.transform(F.filter(F.split(_part(rest, r"(?s)^[^?]*\?(.*)$"), "&"), lambda p: p != ""), pair)
    return let(F.struct(kind.alias("kind"), host.alias("host"), path.alias("path"), query.alias("query")), lambda u: body(u["kind"], u["host"], u["path"], u["query"]))


def _joined(kind: Column, host: Column, path: Column, query: Column) -> Column:
    slashed = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    place = (
        F.when(host != "", F.concat(F.lit("//"), host, slashed)).when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(kind.isin(WITH_AUTHORITY) & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path)).otherwise(path)
    )
    return F.concat(F.when(kind == "", "").otherwise(F.concat(kind, F.lit(":"))), place, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_url(url: Column, tracking: list[str] = TRACKING) -> Column:
    """Scheme and authority in lower case without a leading www., path without the last segment's ;parameters and
    without trailing slashes (the root stays), decoded parameters that are not tracking and not blank, the first of each
    name, by name; no fragment. White space around goes; null stays null."""

    def of(kind: Column, host: Column, path: Column, query: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(path, r"(?s);[^/]*$", ""), "/+$", "")
        kept = F.filter(query, lambda q: (q["v"] != "") & ~F.lower(q["k"]).isin(tracking))

        def firsts(ps: Column) -> Column:
            return F.transform(F.array_sort(F.array_distinct(F.transform(ps, lambda q: q["k"]))), lambda k: F.concat(k, F.lit("="), F.get(F.filter(ps, lambda q: q["k"] == k), F.lit(0))["v"]))

        return _joined(kind, F.regexp_replace(host, r"^www\.", ""), F.when(bare == "", "/").otherwise(bare), F.array_join(let(kept, firsts), "&"))

    return _parsed(url, of)


def review_url(url: Column) -> Column:
    """The review key: blank values and repeated names stay, utm_* and click ids go, the rest encoded again and in the
    order of name and value; https where there is no scheme, the root's slash stays. Null and blank give an empty string."""

    def of(kind: Column, host: Column, path: Column, query: Column) -> Column:
        bare = F.regexp_replace(path, "/+$", "")
        kept = F.array_sort(F.filter(query, lambda q: ~F.lower(q["k"]).isin(REVIEW_TRACKING) & ~F.startswith(F.lower(q["k"]), F.lit("utm_"))))
        items = F.array_join(F.transform(kept, lambda q: F.concat(quoted(q["k"]), F.lit("="), quoted(q["v"]))), "&")
        return _joined(F.when(kind == "", "https").otherwise(kind), F.regexp_replace(host, r"^www\.", ""), F.when(bare == "", path).otherwise(bare), items)

    raw = F.coalesce(url, F.lit(""))
    return F.when(trimmed(raw) == "", "").otherwise(_parsed(raw, of))


def plain_url_key(url: Column) -> Column:
    """Authority and path without a trailing slash, case kept, query dropped."""
    return F.concat(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"), F.regexp_replace(url_path(url), "/+$", ""))


def domain(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def cleaned_text_path(url: Column) -> Column:
    """<domain>/<first 16 digits of the url's SHA-256>.txt"""
    return F.concat(F.regexp_replace(domain(url), r"[^A-Za-z0-9_.-]", "_"), F.lit("/"), F.left(F.sha2(url, 256), F.lit(16)), F.lit(".txt"))


@F.pandas_udf(StringType())
def _decomposed(part: pd.Series) -> pd.Series:
    return part.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD), which no built-in function has; ASCII texts are as they are."""
    other = F.octet_length(text) != F.char_length(text)
    return F.when(other, _decomposed(F.when(other, text))).otherwise(text)


def normal_title(title: Column) -> Column:
    """Lower case, letters decomposed, digits of any script joined over separators, punctuation and marks to spaces, spaces folded."""
    t = F.regexp_replace(decomposed(F.lower(title)), r"(\p{Nd})[,.](\p{Nd})", "$1$2")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.btrim(F.regexp_replace(t, r"(\p{Nd}) (\p{Nd})", "$1$2"))


def text_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.sha2(text, 256))


def padded(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else one space, a space at both ends: terms are found as " term "."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def padded_terms(text: Column, terms: list[str], cap: int | None = None) -> Column:
    """The terms that stand in the padded text, longest first, then in the given order; cap of them at most."""
    ordered = sorted(dict.fromkeys(terms), key=lambda t: -len(t))
    hits = let(padded(text), lambda p: F.array_compact(F.array(*(F.when(F.contains(p, F.lit(f" {t} ")), F.lit(t)) for t in ordered))))
    return F.slice(hits, 1, cap) if cap else hits


def whole(term: str) -> str:
    """A regular expression for the term between word boundaries of any script."""
    def edge(c: str, look: str) -> str:
        return f"(?{look}{'!' if c.isalnum() or c == '_' else '='}{WORD})"

    return f"{edge(term[0], '<')}{re.escape(term)}{edge(term[-1], '')}"


def terms_in_low(low: Column, terms: list[str]) -> Column:
    """The terms that stand in a lower-cased text as whole words, in the order of the list, each once. The cheap look
    for the bare string comes first, so most terms never run a regular expression."""
    own = [t for t in dict.fromkeys(terms) if t]
    if not own:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())) & low.rlike(whole(t.lower())), F.lit(t)) for t in own)))


def terms_in(text: Column, terms: list[str]) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: terms_in_low(low, terms))


def around(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """Text from before characters ahead of a place (from 1) to after characters behind length more, trimmed."""
    first = F.greatest(F.lit(1), start - before)
    return trimmed(F.substring(text, first, start + length + after - first))


def term_evidence(text: Column, low: Column, terms: Column, before: int = 100, after: int = 140) -> Column:
    """Text around the first of the terms (an array, lower-cased here) that stands in it; empty where none does."""
    here = F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: F.contains(low, t))
    return let(F.get(here, F.lit(0)), lambda t: F.when(t.isNull(), "").otherwise(around(text, F.instr(low, t), F.length(t), before, after)))


def pattern_evidence(text: Column, patterns: list[str], before: int = 80, after: int = 100) -> Column:
    """Text around the match of the first of the patterns, in any case, that matches; empty where none does."""
    out = F.lit("")
    for pattern in reversed(patterns):
        at = F.regexp_instr(text, F.lit(f"(?i){pattern}"))
        out = F.when(at > 0, around(text, at, F.length(F.regexp_substr(text, F.lit(f"(?i){pattern}"))), before, after)).otherwise(out)
    return out


def proximity_evidence(text: Column, left: list[str], right: list[str], reach: int = 90) -> Column:
    """The text up to reach characters on both sides of the first left term, in the order of the lists, that has a right
    term as whole words there; the left one counts within words, too. Empty where there is none."""
    if not left or not right:
        return F.lit("")

    def having(b: str):
        return lambda x: F.contains(F.lower(x), F.lit(b)) & F.lower(x).rlike(whole(b))

    def of_left(a: str) -> Column:
        # The literal comes first, so that only its places are looked around. Behind it so many characters are one try; only
        # near the text's start all lengths are tried. The last group holds always: a character of two code units in the
        # pattern makes Java count characters behind a place, and not code units.
        found = f"(?is)\\Q{a}\\E(?:(?<=(.{{{reach}}}\\Q{a}\\E))|(?<=(\\A.{{0,{max(reach - 1, 0)}}}\\Q{a}\\E)))(?=(.{{0,{reach}}}))(?!\U0001F600\\b\\B)"
        sides = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(found), F.lit(k + 1)).alias(c) for k, c in enumerate("xyz")))
        here = F.transform(sides, lambda p: F.concat(p["x"], p["y"], p["z"]))
        return let(here, lambda h: F.coalesce(*(F.get(F.filter(h, having(b)), F.lit(0)) for b in rights)))

    def of_low(low: Column) -> Column:
        return F.coalesce(trimmed(F.coalesce(*(F.when(F.contains(low, F.lit(a)), of_left(a)) for a in dict.fromkeys(t.lower() for t in left)))), F.lit(""))

    rights = [t.lower() for t in dict.fromkeys(right)]
    return let(F.lower(text), of_low)


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of a raw phrase that do not overlap, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def tokens(text: Column, stop: list[str] = (), least: int = 3) -> Column:
    """ASCII tokens in lower case that start with a letter, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z0-9&/-]*)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(list(stop) or [""]))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; none where there are fewer."""
    if n == 1:
        return words
    side = F.arrays_zip(words.alias("w0"), *(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(1, n)))
    whole = F.slice(side, 1, F.greatest(F.size(words) - n + 1, F.lit(0)))
    return F.transform(whole, lambda s: F.concat_ws(" ", *(s[f"w{k}"] for k in range(n))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def clean_date(text: Column) -> Column:
    """The first yyyy-mm-dd in the text; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def any_date(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def in_range(date: Column, first: str, last: str) -> Column:
    """Dates are compared as text by their first ten characters."""
    return F.coalesce(F.left(date, F.lit(10)).between(first, last), F.lit(False))


def missing(text: Column, tokens_: list[str] = EMPTY) -> Column:
    return F.when(F.lower(F.btrim(text)).isin(tokens_), None).otherwise(F.btrim(text))


def tri_state(text: Column) -> Column:
    low = F.lower(F.btrim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("1", "1.0", "true", "yes", "y", "relevant"), "relevant").when(low.isin("0", "0.0", "false", "no", "n", "irrelevant", "not relevant"), "irrelevant").otherwise("pending")


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case letters and digits with dashes between; the text's SHA-1 where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.left(F.sha1(text), F.lit(16))).otherwise(F.left(s, F.lit(most)))


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(most)), r"\s+\S*\z", ""), F.lit("...")))


def strip_markup(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, " ", " "), r"\s+", " "))


def snippet(text: Column, terms: list[str], before: int = 100, after: int = 140) -> Column:
    """Text around the first of the terms, in the order of the list, that occurs; empty where none does."""
    low, out = F.lower(text), F.lit("")
    for term in reversed(terms):
        at = F.instr(low, term)
        start = F.greatest(F.lit(1), at - before)
        out = F.when(at > 0, F.btrim(F.substring(text, start, at + len(term) + after - start))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def near(text: Column, left: list[str], right: list[str], reach: int = 90) -> Column:
    """Whether a left and a right term stand within reach characters, in either order."""
    a, b = ("(" + "|".join(sorted(t, key=lambda x: -len(x))) + ")" for t in (left, right))
    return F.lower(text).rlike(f"{a}.{{0,{reach}}}{b}|{b}.{{0,{reach}}}{a}")


def repaired(text: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, put right; other text as it is; typographic quotes become plain ones."""
    fits = F.coalesce(text, F.lit("")).rlike(r"\A[\x00-\xFF]*[\xC2-\xF4][\x80-\xBF][\x00-\xFF]*\z")
    bytes_ = F.encode(text, "ISO-8859-1")
    fixed = F.when(fits, F.decode(bytes_, "UTF-8")).otherwise(text)
    return F.translate(F.coalesce(fixed, text), "‘’“”", "''\"\"")


def json_object(text: Column, schema: str) -> Column:
    """The JSON object that stands in the text, from its first brace to its last; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def clamp(text: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(text.try_cast("double"), F.lit(least))))


def stem_key(phrase: Column) -> Column:
    """Words of a phrase with plural endings off: ies to y, a final s but not ss."""
    def one(w: Column) -> Column:
        return F.when(w.endswith("ies") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y")).when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)

    return F.array_join(F.transform(F.split(F.btrim(F.lower(phrase)), " +"), one), " ")


def round_name(number: Column) -> Column:
    """round_03 of a number in any spelling; other names in lower case with _ for what is no letter or digit."""
    n = number.try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.lower(number), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.concat(F.lit("round_"), F.coalesce(F.when(n >= 0, F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))), n.cast("string"), plain))


def search_term(term: Column) -> Column:
    """A term of a search string: as it is where it has a field or a wildcard, in quotes where it has a space or a dash."""
    return F.when(term.rlike("[:*]"), term).when(term.rlike("[ -]"), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def or_group(terms: Column, field: str | None = None) -> Column:
    """(a OR "b c" OR "d-e" OR f*) of a search string; a field is put before each term."""
    own = lambda t: F.concat(F.lit(f"{field}:"), search_term(t)) if field else search_term(t)
    return F.concat(F.lit("("), F.array_join(F.transform(terms, own), " OR "), F.lit(")"))


def scoped(query: Column, excluded: Column) -> Column:
    """A search string without what an excluded term finds."""
    return F.concat(F.lit("("), query, F.lit(") AND NOT "), or_group(excluded))


def within(phrase: Column, distance: int) -> Column:
    """A search for a phrase's words at most so far apart."""
    return F.concat(F.lit('"'), phrase, F.lit(f'"~{distance}'))


def variants(url: Column, rules: dict[str, list[str]]) -> Column:
    """The URL and what else its page may stand under: of the first rule whose name is in its host, forms made of
    {base}, {path} (without a trailing slash) and {query} (with its question mark)."""

    def of(kind: Column, host: Column, path: Column, query: Column) -> Column:
        names = {"base": F.concat(kind, F.lit("://"), host), "path": F.regexp_replace(path, "/+$", ""), "query": F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))}

        def form(template: str) -> Column:
            parts = [names[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"({base}|{path}|{query})", template) if x]
            return F.concat(*parts)

        out = F.array(url)
        for name, templates in reversed(rules.items()):
            out = F.when(F.contains(host, F.lit(name)), F.array(url, *map(form, templates))).otherwise(out)
        return F.array_distinct(out)

    bare = F.regexp_replace(url, "#.*$", "")
    u = F.struct(scheme(bare).alias("k"), _part(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)").alias("h"), url_path(bare).alias("p"), url_query(bare).alias("q"))
    return let(u, lambda x: of(x["k"], x["h"], x["p"], x["q"]))
