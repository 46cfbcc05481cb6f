"""Label and text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations, state words, plurals and word lists of the label vocabulary.
ABBREVIATIONS = {"m": "muscle", "a": "artery", "v": "vein", "n": "nerve", "lig": "ligament", "t": "tendon", "br": "branch", "gl": "gland", "mm": "muscles", "aa": "arteries", "vv": "veins", "nn": "nerves"}
STATE_PATTERN = r"(?i)\((?:reflected|cut|retracted|removed|partially[^)]*)\)"
STATES = ("cut", "reflected", "opened", "retracted", "removed", "divided", "refld")
PLURALS = {"muscles": "muscle", "veins": "vein", "nerves": "nerve", "arteries": "artery", "nodes": "node", "vessels": "vessel", "ligaments": "ligament", "tendons": "tendon", "canals": "canal", "sinuses": "sinus", "foramina": "foramen", "branches": "branch", "tubercles": "tubercle", "processes": "process"}
CATEGORIES = {"artery": "artery", "arteries": "artery", "vein": "vein", "veins": "vein", "nerve": "nerve", "nerves": "nerve", "muscle": "muscle", "muscles": "muscle", "bone": "bone", "joint": "bone", "tendon": "muscle"}
CATEGORY_RULES = (("artery", "artery"), ("arteria", "artery"), ("vein", "vein"), ("vena", "vein"), ("nerve", "nerve"), ("nervus", "nerve"), ("muscle", "muscle"), ("musculus", "muscle"), ("bone", "bone"))
REGIONS = ("abdom", "pelvi", "thora", "neck", "oral", "cranial", "orbit", "thigh", "arm", "forearm", "leg", "foot", "hand", "shoulder", "brachial", "face", "nasal", "spinal", "gluteal", "head", "back")
THIN = ("artery", "arteria", "arterial", "vein", "vena", "venous", "nerve", "nervus", "vessel", "vasa", "duct", "ductus", "trunk", "truncus", "ramus")
LATERALITY = ("l", "r", "left", "right")
DIRECTIONS = ("lateral", "medial", "superior", "inferior", "anterior", "posterior", "deep", "superficial", "upper", "lower", "middle", "proximal", "distal", "dorsal", "ventral", "internal", "external", "ascending", "descending")
GARBLED = r"(?i)[bcdfghjklmnpqrstvwxz]{4,}|brachil|\blac\b|\bm\b$|nerv$|arter$"
LATIN = (("muscle|musculus|m", "muscle"), ("nerve|nervus|n", "nerve"), ("artery|arteria|a", "artery"), ("vein|vena|v", "vein"))
ANSWER = r"(?i)ANSWER:\s*(.+?)\s+CONF:\s*([0-9]*\.?[0-9]+)"
PROMPT_HEAD = ("You identify a structure from its surroundings.", "", "Surroundings:")
PROMPT_TAIL = ("", "Give one line of reasons, then end with exactly this line:", "ANSWER: <structure name>  CONF: <confidence 0-1>")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def normalise(raw: Column) -> Column:
    """Lower case, no state notes, no punctuation, abbreviations written out."""
    s = F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("\n"), F.lit(" ")), STATE_PATTERN, "")
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    return F.array_join(F.transform(tokens(s), lambda t: F.coalesce(F.element_at(lookup(ABBREVIATIONS), t), t)), " ")


def normalise_latin(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(F.lower(raw)), r"\(.*?\)", "")
    for words, to in LATIN:
        s = F.regexp_replace(s, rf"\b({words})\b", to)
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z ]", " "), r"\s+", " "))


def normalise_answer(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9 ]", " "), r"\s+", " "))


def strip_state(label: Column) -> Column:
    """Trailing state words go, however many."""
    s = F.array_join(tokens(label), " ")
    return F.trim(F.regexp_replace(s, rf"(^|\s)(({'|'.join(STATES)})(\s|$))+$", ""))


def is_garbage(label: Column) -> Column:
    return (F.length(F.trim(label)) < 2) | ~label.rlike(r"\p{L}")


def slug(text: Column, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def is_valid(label: Column, keyword: str, generic: tuple[str, ...], known: tuple[str, ...]) -> Column:
    """Plausible label: rules in order, the first that applies decides."""
    s = F.trim(label)
    t = tokens(s)
    one = F.size(t) == 1
    proper = F.size(F.filter(t, lambda x: x.rlike("^[a-z]+$") & x.rlike("[aeiou]")))
    return (
        F.when((F.length(s) < 4) | ~s.rlike("[aeiou]"), False)
        .when(F.forall(t, lambda x: F.length(x) < 3), False)
        .when(one & F.array_contains(strings(generic), F.element_at(t, 1)), False)
        .when(s.rlike(rf"\b({keyword})\b"), True)
        .when(one, F.array_contains(strings(known), F.element_at(t, 1)))
        .otherwise(proper >= 2)
    )


def category(label: Column, words: dict[str, str] = CATEGORIES, cranial: bool = False) -> Column:
    """Category of the last token that has one; with cranial, any token 'cn' makes it a nerve."""
    known = F.filter(tokens(label), lambda t: F.map_contains_key(lookup(words), t))
    out = F.when(F.size(known) > 0, F.element_at(lookup(words), F.element_at(known, -1))).otherwise("other")
    return F.when(F.array_contains(tokens(label), "cn"), "nerve").otherwise(out) if cranial else out


def first_rule(text: Column, rules, otherwise: str = "other") -> Column:
    """The first rule whose word the text contains."""
    out = F.lit(otherwise)
    for word, value in reversed(list(rules)):
        out = F.when(F.contains(F.lower(text), F.lit(word)), value).otherwise(out)
    return out


def region(text: Column) -> Column:
    return first_rule(text, [(w, w) for w in REGIONS])


def thin_or_bulk(label: Column) -> Column:
    return F.when(F.lower(label).rlike("|".join(THIN)), "thin").otherwise("bulk")


def informative(label: Column, leave_out: tuple[str, ...], least: int = 1) -> Column:
    return F.filter(F.array_except(tokens(label), strings(leave_out)), lambda t: F.length(t) >= least)


def is_garbled(label: Column) -> Column:
    return label.rlike(GARBLED) | (F.length(label) < 3) | F.exists(tokens(label), lambda t: (F.length(t) >= 4) & ~t.rlike("[aeiou]"))


def parse_answer(text: Column) -> Column:
    """The last 'ANSWER: x CONF: y': answer, and confidence within [0, 1]."""
    answers, confs = F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)), F.regexp_extract_all(text, F.lit(ANSWER), F.lit(2))
    some = F.size(answers) > 0
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(confs, -1).cast("double")))
    return F.struct(F.when(some, F.trim(F.element_at(answers, -1))).alias("answer"), F.when(some, conf).otherwise(0.0).alias("conf"))


def parse_choice(text: Column, k: int) -> Column:
    """Number of the last line with 'ANSWER: n', else the first number of the last line; null beyond 1..k."""
    lines = F.split(F.trim(text), "\n")
    said = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"ANSWER:\s*(\d+)", 1)), lambda x: x != "")
    last = F.regexp_extract(F.element_at(lines, -1), r"\b(\d+)\b", 1)
    n = F.when(F.size(said) > 0, F.element_at(said, -1)).otherwise(F.nullif(last, F.lit(""))).cast("int")
    return F.when(n.between(1, k), n)


def parse_legend(text: Column) -> Column:
    """Array of (number, name) from running text '1 First name 2 Second ...': 1..60, names of 3 to 50 characters."""
    s = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    found = r"(?<!\d)(\d{1,2})\s(.*?)(?=(?<!\d)\d{1,2}\s|$)"
    pair = F.zip_with(F.regexp_extract_all(s, F.lit(found), F.lit(1)), F.regexp_extract_all(s, F.lit(found), F.lit(2)), lambda n, x: F.struct(n.cast("int").alias("number"), F.lower(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z .,()-]", ""), "^[ .,-]+|[ .,-]+$", "")).alias("name")))
    good = F.filter(pair, lambda p: p["number"].between(1, 60) & F.length(p["name"]).between(3, 50))
    return F.filter(good, lambda p, i: F.size(F.filter(F.slice(good, F.lit(1), i), lambda o: o["number"] == p["number"])) == 0)


def sentences(subject: Column, relations: Column) -> Column:
    """relations: array of (rel, phrase, names). One line a relation, names distinct and sorted."""
    lines = F.transform(F.array_sort(relations), lambda r: F.concat(F.lit("It is "), r["phrase"], F.lit(" "), F.array_join(F.array_sort(F.array_distinct(r["names"])), ", "), F.lit(".")))
    none = F.array(F.lit("It has no recorded neighbours."))
    return F.array_join(F.concat(F.array(F.concat(F.lit("It lies on: "), subject, F.lit("."))), F.when(F.size(relations) > 0, lines).otherwise(none)), "\n")


def prompt(surroundings: Column, candidates: Column | None = None) -> Column:
    parts = [F.lit(x) for x in PROMPT_HEAD] + [surroundings]
    if candidates is not None:
        parts += [F.lit(""), F.lit("Choose one of:"), F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")]
    return F.array_join(F.array(*parts, *[F.lit(x) for x in PROMPT_TAIL]), "\n")


# -- table forms


def fix(rows: DataFrame, column: str, fixes: DataFrame) -> DataFrame:
    """fixes: from, to. A null `to` drops the row; a value without an entry, null included, stays.

    Of several entries for one value the smallest `to` counts, and the row goes only if all of them are null.
    """
    to, hit = (next(n for n in (f"_{w}{k or ''}" for k in range(len(rows.columns) + 1)) if n not in rows.columns) for w in ("to", "hit"))
    table = fixes.groupBy(F.col("from").alias(column)).agg(F.min("to").alias(to)).withColumn(hit, F.lit(True))
    out = rows.join(table, column, "left").where(F.col(hit).isNull() | F.col(to).isNotNull())
    return out.withColumn(column, F.coalesce(to, column)).select(*rows.columns)



def singular(rows: DataFrame, column: str) -> DataFrame:
    """The last token loses its plural where the singular label is attested in the data."""
    t = tokens(F.col(column))
    one = F.element_at(lookup(PLURALS), F.element_at(t, -1))
    rows = rows.withColumn("_one", F.when(one.isNotNull(), F.array_join(F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(one)), " ")))
    attested = rows.select(F.col(column).alias("_one")).distinct().withColumn("_yes", F.lit(True))
    return rows.join(attested, "_one", "left").withColumn(column, F.when(F.col("_yes"), F.col("_one")).otherwise(F.col(column))).drop("_one", "_yes")


def vocabulary(rows: DataFrame, column: str, order: str) -> DataFrame:
    """label, label_id: dense in first-seen order. One row a label, numbered by ranges."""
    from embergrid.operators import ranking

    first = rows.groupBy(F.col(column).alias("label")).agg(F.min(order).alias("_o"))
    return ranking.ranged(first, [], [F.col("_o"), F.col("label")]).select("label", (F.col("rank") - 1).alias("label_id"))


def boilerplate(label: Column) -> Column:
    """Empty, an address, or the reading program's own words."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return (low == "") | F.contains(low, F.lit("http")) | F.contains(low, F.lit("adobe"))


def decline(prompts: pd.Series) -> pd.Series:
    """The text backend where none is given."""
    return pd.Series(["ANSWER: none CONF: 0.0"] * len(prompts), dtype=str)


def replies(rows: DataFrame, prompt: str, backend: Callable[[pd.Series], pd.Series] = decline) -> DataFrame:
    """rows with `reply`: what the backend, a function of a batch of prompts, says."""
    return rows.withColumn("reply", F.pandas_udf(backend, "string")(F.col(prompt)))


def mapped_names(rows: DataFrame, known: DataFrame, name: str, label: str, order: str, namespace: str = "EXT::") -> DataFrame:
    """rows with label and matched: the known label of the same normalised name - the first by `order` wins - else the name in a namespace of its own."""
    first = known.groupBy(F.col(name).alias("_name")).agg(F.min_by(label, order).alias("_label"))
    met = rows.drop("label").join(first, F.col(name) == F.col("_name"), "left")
    return met.select("*", F.coalesce("_label", F.concat(F.lit(namespace), name)).alias("label"), F.col("_label").isNotNull().alias("matched")).drop("_name", "_label")
