"""Code-oriented text functions as Spark columns; each has a SQL spelling for comparison."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Irregular forms of code-search terms.
IRREGULAR = {
    "resolution": "resolve", "resolved": "resolve", "resolver": "resolve", "resolving": "resolve",
    "solved": "solve", "solving": "solve", "compiled": "compile", "compiling": "compile",
    "registered": "register", "registering": "register", "routing": "route", "aliases": "alias", "using": "use",
    "searched": "search", "searching": "search", "represented": "represent", "representing": "represent",
    "created": "create", "creating": "create", "mapped": "map", "mapping": "map", "tracked": "track", "tracking": "track",
    "enabled": "enable", "enabling": "enable", "sent": "send", "sending": "send", "opened": "open", "opening": "open",
    "loaded": "load", "loading": "load", "changed": "change", "changing": "change", "compacted": "compact", "compacting": "compact",
    "configured": "configure", "configuring": "configure", "converted": "convert", "converting": "convert",
    "deleted": "delete", "deleting": "delete", "executed": "execute", "executing": "execute", "merged": "merge", "merging": "merge",
    "optimized": "optimize", "optimizing": "optimize", "restored": "restore", "restoring": "restore",
    "formatted": "format", "formatting": "format", "parsed": "parse", "parsing": "parse",
    "processed": "process", "processing": "process", "dispatched": "dispatch", "dispatching": "dispatch",
    "implemented": "implement", "implementing": "implement", "handled": "handle", "handling": "handle",
    "added": "add", "adding": "add", "invoked": "invoke", "invoking": "invoke",
    "recognized": "recognize", "recognizing": "recognize", "scheduled": "schedule", "scheduling": "schedule",
}

#: Stems that take a silent e back.
SILENT_E = "(at|abl|il|v)$"

#: Question words left out of query terms, unless nothing else is left.
STOP_WORDS = (
    "how", "what", "when", "where", "which", "who", "whom", "whose", "does", "did", "is", "are", "was", "were", "be", "been",
    "being", "can", "could", "should", "would", "will", "shall", "may", "might", "must", "has", "have", "had", "the", "and", "but",
    "not", "for", "from", "with", "without", "into", "onto", "off", "that", "this", "these", "those", "there", "here", "its", "their",
    "them", "they", "about", "any", "some", "work", "works", "working", "implement", "implemented", "implementation", "der", "die", "das", "den", "dem",
    "ein", "eine", "und", "oder", "nicht", "wie", "wer", "wann", "wo", "warum", "wieso", "welche", "welcher", "welches", "ist", "sind",
    "wird", "wurde", "hat", "haben", "kann", "koennen", "können", "soll", "muss", "sich", "bei", "mit", "von", "fuer", "für", "ueber",
    "über", "nach", "aus", "gibt", "es", "funktioniert", "geaendert", "geändert", "aendert", "ändert", "pourquoi", "quand", "quel", "quelle", "quels", "quelles",
    "quoi", "qui", "que", "est", "sont", "fonctionne", "cette", "dans", "avec", "où", "cómo", "como", "qué", "cuál", "cuáles", "cuándo",
    "dónde", "donde", "porque", "por", "para", "funciona", "está", "están", "hay", "qual", "quais", "quando", "onde", "são", "estão", "tem",
    "uma", "não", "perché", "cosa", "quale", "quali", "dove", "funziona", "sono", "che", "della",
)

#: Question words that ask for a relationship context.
CONTEXT_HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}


def _mapping(form: str, keep_marks: bool) -> tuple[str, str]:
    """Characters that a normal form replaces by one other, and their replacements, by rule."""
    old, new = [], []
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables stay whole; surrogates are no characters
            continue
        c = chr(code)
        plain = [x for x in unicodedata.normalize(form, c) if keep_marks or not unicodedata.combining(x)]
        if len(plain) == 1 and plain[0] != c:
            old.append(c)
            new.append(plain[0])
    return "".join(old), "".join(new)


_PLAIN, _COMPATIBLE = _mapping("NFKD", False), _mapping("NFKC", True)


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks, inside the JVM: composed ones are mapped to their base, loose marks dropped.

    Characters that decompose into several letters (ligatures) stay as they are.
    """
    return F.regexp_replace(F.translate(c, *_PLAIN), r"\p{Mn}+", "")


def identifier_tokens(c: Column) -> Column:
    """Words of an identifier: marks stripped, camel case and acronyms split, lower case, underscores kept."""
    split = F.regexp_replace(F.regexp_replace(strip_diacritics(c), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.regexp_extract_all(F.lower(split), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _suffix_sql(t: str, match: str, fold) -> str:
    """The suffix rules as one SQL CASE; ``match`` and ``fold`` spell the dialect's regular expressions."""
    m = lambda p: match.format(t, p)
    base = lambda n: f"substring({t}, 1, length({t}) - {n})"

    bare = fold
    return (
        f"CASE WHEN {m('[^ -~]')} THEN {t} "
        f"WHEN {m('^..+ies$')} THEN concat({base(3)}, 'y') "
        f"WHEN {m('(sses|xes|zes|ches|shes|uses)$')} THEN {base(2)} "
        f"WHEN {m('^..+[^suia]s$')} THEN {base(1)} "
        f"WHEN {m('^...+ing$')} THEN {bare(base(3))} "
        f"WHEN {m('^..+ied$')} THEN concat({base(3)}, 'y') "
        f"WHEN {m('^...+ed$')} THEN {bare(base(2))} "
        f"ELSE {t} END"
    )


def canonical_sql(t: str, dialect: str = "spark") -> str:
    """SQL of the bounded stemmer in Spark's or DuckDB's dialect."""
    match = "rlike({0}, '{1}')" if dialect == "spark" else "regexp_matches({0}, '{1}')"
    last = lambda s, n: f"substring({s}, length({s}) - {n - 1}, 1)"
    single = lambda s: f"CASE WHEN {last(s, 1)} = {last(s, 2)} THEN substring({s}, 1, length({s}) - 1) ELSE {s} END"
    fold = lambda s: f"CASE WHEN {match.format(single(s), SILENT_E)} THEN concat({single(s)}, 'e') ELSE {single(s)} END"
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return f"CASE {t} {irregular} ELSE {_suffix_sql(t, match, fold)} END"


def canonical_token(c: Column) -> Column:
    """One search term in its canonical form: fixed irregular forms, then suffix rules; ASCII only."""
    return _canonical_of(c)


def _canonical_of(t: Column) -> Column:
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    base = lambda n: F.substring(t, F.lit(1), F.length(t) - n)

    def bare(stem):
        last = lambda n: F.substring(stem, F.length(stem) - (n - 1), F.lit(1))
        single = F.when(last(1) == last(2), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
        return F.when(single.rlike(SILENT_E), F.concat(single, F.lit("e"))).otherwise(single)

    rules = (
        F.when(t.rlike("[^ -~]"), t)
        .when(t.rlike("^..+ies$"), F.concat(base(3), F.lit("y")))
        .when(t.rlike("(sses|xes|zes|ches|shes|uses)$"), base(2))
        .when(t.rlike("^..+[^suia]s$"), base(1))
        .when(t.rlike("^...+ing$"), bare(base(3)))
        .when(t.rlike("^..+ied$"), F.concat(base(3), F.lit("y")))
        .when(t.rlike("^...+ed$"), bare(base(2)))
        .otherwise(t)
    )
    return F.coalesce(F.try_element_at(irregular, t), rules)


def search_tokens(c: Column) -> Column:
    return F.transform(identifier_tokens(c), _canonical_of)


def searchable(t: Column) -> Column:
    """Terms of one or two plain letters are not searched."""
    return (t != "") & ~t.rlike("^[a-z]{1,2}$")


#: The block of characters whose words are searched by pairs.
CHINESE = "[\u4e00-\u9fff]"


def query_terms(c: Column) -> Column:
    """Search terms of a question without stop words; if all are stop words, all of them.

    A word that holds a Chinese character gives its pairs of neighbouring characters and,
    if it is none of them, itself.
    """

    def pairs(word):
        n = F.length(word)
        two = F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2))), searchable)
        whole = F.filter(F.array(word), searchable)
        return F.when(n < 2, whole).otherwise(F.concat(two, F.array_except(whole, two)))

    by_word = F.transform(F.split(c, r"\s+"), lambda w: F.when(w.rlike(CHINESE), pairs(F.lower(w))).otherwise(F.filter(search_tokens(w), searchable)))
    terms = F.when(c.rlike(CHINESE), F.flatten(by_word)).otherwise(F.filter(search_tokens(c), searchable))
    content = F.filter(terms, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(content) == 0, terms).otherwise(content)


def context_filters(c: Column) -> Column:
    """Relationship contexts that a question asks for."""
    seen = F.split(F.lower(F.translate(c, "?,", "  ")), r"\s+")
    return F.filter(F.array(*[F.when(F.arrays_overlap(seen, F.array(*[F.lit(w) for w in words])), F.lit(k)) for k, words in CONTEXT_HINTS.items()]), lambda x: x.isNotNull())


def normalize_symbol(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"\(\)$", ""), r"^\.", ""))


def normalize_label(c: Column) -> Column:
    """Compatible characters unified, case folded, every run of other characters than letters and digits as one space."""
    folded = F.regexp_replace(F.lower(F.translate(c, *_COMPATIBLE)), "\u00df", "ss")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of a normalised label; 0 for an empty one."""
    chars = F.split(normalize_label(c), "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(F.length(normalize_label(c)) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base) if base > 0.7 else base


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits, counting a swap of neighbours as one, with edits in between allowed."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = {(-1, -1): far}
    for i in range(len(a) + 1):
        rows[i, -1], rows[i, 0] = far, i
    for j in range(len(b) + 1):
        rows[-1, j], rows[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            rows[i, j] = min(rows[i - 1, j - 1] + cost, rows[i, j - 1] + 1, rows[i - 1, j] + 1, rows[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return rows[len(a), len(b)]


@F.pandas_udf(T.DoubleType())
def jaro_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro(x, y) * 100 for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_winkler_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) * 100 for x, y in zip(a, b)])


@F.pandas_udf(T.LongType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_levenshtein(x, y) for x, y in zip(a, b)], dtype="Int64")


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency of the ranking: ln((N - df + 0.5) / (df + 0.5) + 1)."""
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)

