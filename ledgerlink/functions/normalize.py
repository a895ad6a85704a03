"""Names and addresses in canonical form, as column expressions.

Only folding to ASCII runs in Python, in one Arrow UDF; the rest is array and
regular-expression functions.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.functions import tables as t

_HIDDEN = {c: None for c in [0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065)]} | {ord("°"): " ", ord("º"): " "}

# Letters by their place in a 128-letter block; the nine Indic blocks are laid out alike.
_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split(), strict=True))
_SIGNS = {0x02: "n", 0x03: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
_LETTERS = _VOWELS | _CONSONANTS | _SIGNS | {0x66 + d: str(d) for d in range(10)}
# Latin letters that don't decompose.
_LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "þ": "th", "ð": "d", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

_PARTS = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("indic", T.BooleanType())]))


def fold(text: str) -> str:
    """NFKC, without hidden marks, in lower-case ASCII; Indic scripts letter by letter, without inherent vowels."""
    s = unicodedata.normalize("NFKC", text).translate(_HIDDEN)
    if s.isascii():
        return s.lower()
    out = []
    for ch in s:
        code = ord(ch)
        if code < 128:
            out.append(ch)
        elif 0x900 <= code < 0xE00:
            out.append(_LETTERS.get(code % 0x80, ""))
        elif ch in _LATIN:
            out.append(_LATIN[ch])
        else:
            out.append("".join(x for x in unicodedata.normalize("NFKD", ch) if ord(x) < 128))
    return "".join(out).lower()


@F.pandas_udf(T.StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(_PARTS)
def _folded_parts(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"a": fold(p), "indic": any("ऀ" <= c <= "෿" for c in p)} for p in (x or "").split(",")])


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def simple(c: Column) -> Column:
    """Words of letters and digits with single blanks between; & is a word, dots and quotes vanish."""
    bare = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), "[.'`’]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def ocr_fix(word: Column) -> Column:
    """Digits that look like letters, in words of three letters or more with no other digit."""
    letters = F.char_length(F.regexp_replace(word, "[^a-z]", ""))
    return F.when(word.rlike("[0-9]") & (letters >= 3) & ~word.rlike("[24679]"), F.translate(word, "01358", "olesb")).otherwise(word)


def skeleton(word: Column) -> Column:
    """Consonants that survive vowel loss: gujarat and gujrat are gjrt; digits stay."""
    s = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [("ph", "f"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("kh", "k"), ("bh", "b"), ("dh", "d"), ("gh", "g"), ("jh", "j")], word)
    s = F.translate(s, "zwqcx", "jvkkk")
    rest = F.regexp_replace(F.substr(s, F.lit(2)), "[aeiouyh]", "")
    return F.when(word.rlike("^[0-9]*$"), word).otherwise(F.regexp_replace(F.concat(F.substring(s, 1, 1), rest), r"(.)\1+", "$1"))


def _sorted_set(a: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(a)), " ")


def normalize_names(df: DataFrame, raw: str = "business_name", token_map: dict[str, str] | None = None) -> DataFrame:
    """``df`` with name_norm, name_core, name_key, name_skel, name_legal, name_alt, name_is_domain and name_indic."""
    given = F.coalesce(F.col(raw), F.lit(""))
    one = df.withColumn("__s", to_ascii(given)).withColumn("name_indic", given.rlike("[\\u0900-\\u0DFF]"))
    domain = F.regexp_extract("__s", rf"^\s*[#@]?(?:https?://)?(?:www\.)?([a-z0-9-]+)\.{t.TLD}\s*$", 1)
    tag = F.regexp_extract("__s", r"^\s*#([a-z0-9]{4,})\s*$", 1)
    whole = F.when(domain != "", domain).otherwise(tag)
    bare = F.regexp_replace(F.regexp_replace("__s", r"\s*\|\s*.*$", ""), rf"\b(?:https?://)?(?:www\.)?[a-z0-9-]+\.{t.TLD}\b", " ")
    clean = simple(F.when(whole != "", F.replace(whole, F.lit("-"), F.lit(" "))).otherwise(bare))
    joined = reduce(lambda c, x: F.regexp_replace(c, r"\b" + " ".join(x) + r"\b", x), t.SPELLED, clean)
    joined = F.regexp_replace(joined, r"\bpvt\s*ltd\b", "pvt ltd")
    two = one.withColumn("name_is_domain", whole != "").withColumn("__p", F.split(joined, t.ALIAS, 2))
    has = (F.size("__p") == 2) & (F.trim(F.get("__p", 1)) != "")
    now = F.when(has, F.trim(F.get("__p", 1))).otherwise(joined)
    three = two.withColumn("name_alt", F.when(has, F.trim(F.get("__p", 0))).otherwise(F.lit(""))).withColumn("__t", F.transform(words(now), ocr_fix))
    tokens = F.col("__t")
    if token_map:
        known = _literal_map(token_map)
        tokens = F.when(F.col("name_indic"), F.transform(tokens, lambda x: F.coalesce(F.try_element_at(known, x), x))).otherwise(tokens)
    legal = _literal_map(t.LEGAL)
    four = three.withColumn("__t", F.transform(tokens, lambda x: F.coalesce(F.try_element_at(legal, x), x)))
    forms, stop = _array(sorted(set(t.LEGAL.values()))), _array(t.NAME_STOP)
    core = F.filter("__t", lambda x: ~F.array_contains(forms, x) & ~F.array_contains(stop, x))
    five = four.withColumn("__c", core).withColumn("__c", F.when(F.size("__c") > 0, F.col("__c")).otherwise(F.col("__t")))
    return five.select(
        *df.columns,
        F.array_join("__t", " ").alias("name_norm"),
        F.array_join("__c", " ").alias("name_core"),
        _sorted_set(F.col("__c")).alias("name_key"),
        F.array_join(F.transform("__c", skeleton), " ").alias("name_skel"),
        _sorted_set(F.filter("__t", lambda x: F.array_contains(forms, x))).alias("name_legal"),
        "name_alt", "name_is_domain", "name_indic",
    )


def _by_country(tables_: dict[str, dict[str, str]]) -> Column:
    """One map, its keys led by the country."""
    return _literal_map({f"{country}|{k}": v for country, table in tables_.items() for k, v in table.items()})


def _ordinal_fix(word: Column) -> Column:
    """54rd is 54th."""
    n = F.regexp_extract(word, "^([0-9]+)(?:st|nd|rd|th)$", 1)
    last = F.substring(n, -1, 1)
    suffix = F.when(F.regexp_extract(n, "(1[0-9]|20)$", 1) != "", "th").when(last == "1", "st").when(last == "2", "nd").when(last == "3", "rd").otherwise("th")
    return F.when(n != "", F.concat(n, suffix)).otherwise(word)


def normalize_addresses(df: DataFrame, raw: str = "business_address", country: str = "country", state_map: dict[str, str] | None = None) -> DataFrame:
    """``df`` with addr_norm, addr_key, addr_street, addr_localities, addr_state, addr_postcode, addr_nums, addr_house_no and addr_empty.

    A country without tables has the US street words and no states.
    """
    land = F.coalesce(F.col(country), F.lit(""))
    noise = lambda a: reduce(lambda c, pattern: F.regexp_replace(c, pattern, " "), t.NOISE, a)
    parts = F.transform(_folded_parts(F.coalesce(F.col(raw), F.lit(""))), lambda p: F.struct(simple(noise(p["a"])).alias("a"), p["indic"].alias("indic")))
    one = df.withColumn("__parts", parts).withColumn("__parts", F.filter("__parts", lambda p: p["a"] != ""))
    states, short = _by_country(t.STATES), _array([f"{c}|{s}" for c, names in t.SHORT_STATES.items() for s in names])
    learnt = _literal_map(state_map) if state_map else None

    def found(p: Column, i: Column) -> Column:
        key = F.concat(land, F.lit("|"), p["a"])
        state = F.try_element_at(states, key)
        if learnt is not None:
            state = F.coalesce(state, F.when(p["indic"], F.try_element_at(learnt, p["a"])))
        return F.struct(F.array_contains(short, key).alias("short"), i.alias("i"), state.alias("state"))

    best = F.array_max(F.filter(F.transform("__parts", found), lambda x: x["state"].isNotNull()))
    two = one.withColumn("__state", best)
    lengths = F.when(land == "US", _array(["5"])).when(land == "France", _array(["5"])).when(land == "India", _array(["6"])).otherwise(_array(["5", "6"]))
    last = lambda a: F.element_at(F.split(a, " "), -1)
    code = F.filter("__parts", lambda p, i: last(p["a"]).rlike("^[0-9]+$") & F.array_contains(lengths, F.char_length(last(p["a"])).cast("string")) & ((i > 0) | p["a"].contains(" ")))
    two = two.withColumn("addr_postcode", F.coalesce(F.element_at(F.split(F.get(code, F.size(code) - 1)["a"], " "), -1), F.lit("")))
    street, prefix = _by_country(t.STREETS), _array(t.NUMBER_PREFIX)
    table = F.when(land.isin(*t.STREETS), land).otherwise("US")

    def canonical(p: Column) -> Column:
        w = words(p["a"])
        kept = F.filter(w, lambda x, i: ~(F.array_contains(prefix, x) & F.coalesce(F.get(w, i + 1).rlike("^[0-9]"), F.lit(False))))
        return F.transform(kept, lambda x: _ordinal_fix(F.coalesce(F.try_element_at(street, F.concat(table, F.lit("|"), x)), x)))

    rest = F.filter("__parts", lambda p, i: F.coalesce(i != F.col("__state")["i"], F.lit(True)))
    three = two.withColumn("__w", F.filter(F.transform(rest, canonical), lambda a: F.size(a) > 0))
    joined = F.transform("__w", lambda a: F.array_join(a, " "))
    four = three.withColumn("__j", joined).withColumn("__all", F.flatten("__w"))
    streets = F.filter("__j", lambda a: a.rlike("[0-9]"))
    numbers = F.filter(F.regexp_extract_all(F.array_join(streets, " "), F.lit("([0-9]+)"), F.lit(1)), lambda d: d != F.col("addr_postcode"))
    five = four.withColumn("__n", F.array_distinct(F.transform(numbers, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""))))
    return five.select(
        *df.columns,
        F.array_join("__all", " ").alias("addr_norm"),
        _sorted_set(F.col("__all")).alias("addr_key"),
        F.array_join(streets, " | ").alias("addr_street"),
        F.array_join(F.filter("__j", lambda a: ~a.rlike("[0-9]")), " | ").alias("addr_localities"),
        F.coalesce(F.col("__state")["state"], F.lit("")).alias("addr_state"),
        "addr_postcode",
        F.array_join("__n", " ").alias("addr_nums"),
        F.coalesce(F.get("__n", 0), F.lit("")).alias("addr_house_no"),
        (F.size("__parts") == 0).alias("addr_empty"),
    )


def learn_maps(pairs: DataFrame, country: str = "India", min_count: int = 3, min_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """From true pairs of one country: what native words and native address parts mostly stand against.

    pairs: business_name_1, business_address_1 and the same with _2, the records
    of the reference list first; only pairs of training data may be given.  Two
    tables with native, latin (a word, legal forms canonical) and native, state.
    """
    from ledgerlink.operators.features import majority_map

    indic = "[\\u0900-\\u0DFF]"
    folded = lambda c: words(simple(to_ascii(F.coalesce(F.col(c), F.lit("")))))
    named = pairs.filter(F.col("business_name_2").rlike(indic)).select(folded("business_name_2").alias("a"), folded("business_name_1").alias("b")).filter(F.size("a") == F.size("b"))
    each = named.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("native"), F.col("z.b").alias("latin")).filter("native <> latin")
    legal = _literal_map(t.LEGAL)
    words_of = majority_map(each.withColumn("latin", F.coalesce(F.try_element_at(legal, F.col("latin")), F.col("latin"))), "native", "latin", min_count, min_share)
    placed = normalize_addresses(pairs.withColumn("__land", F.lit(country)), "business_address_1", "__land").filter("addr_state <> ''")
    parts = placed.select("addr_state", F.explode(_folded_parts(F.coalesce(F.col("business_address_2"), F.lit("")))).alias("p")).filter("p.indic").select(simple(F.col("p.a")).alias("native"), F.col("addr_state").alias("state"))
    return words_of, majority_map(parts.filter("native <> ''"), "native", "state", min_count, min_share)


def as_map(table: DataFrame, most: int = 100_000) -> dict[str, str]:
    """A learnt table as a map for ``normalize_names`` and ``normalize_addresses``; more rows than ``most`` are an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    return {r[0]: r[1] for r in rows}
