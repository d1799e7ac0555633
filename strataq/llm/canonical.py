"""Freely entered values mapped to the entries of a reference list.

1. Values are folded (width, accents, look-alike letters, case) and cut into runs
   of letters and numbers; a trailing .0 of a number doesn't count. A value that is
   an id written in one piece or with other blanks is cut as the id is.
2. Each distinct token is joined to the reference vocabulary: as it is, else by
   edit distance, for which both sides offer the token itself and its forms with
   one letter deleted as keys (two letters for long words), the vocabulary also its
   beginnings as abbreviations; pairs that share a key are verified. One edit is
   allowed (two in words of LONG letters or more); shorter words keep their first
   letter, as another one makes another word (bcrypt, scrypt). Numbers and the
   short code words of the entries' ids are never repaired.
3. Values with the same corrected tokens share a signature. The names of the
   entries (id, title with version, title or stem alone where only one entry has
   it) that hold the signature's rarest token are ranked by soft TF-IDF: the cosine
   of idf weights in which a repaired token counts with its similarity. Common
   words weigh next to nothing.
4. An exact check follows: the best name is meant if nothing of it is missing and
   nothing in the value is left over, common words aside; so another version, size
   or variant maps to 'none', as do values that name nothing in the list.

Vocabulary, names and tokens are tables that are joined; only the number of names
of each list comes to the driver. All lists and fields go through one pass, the
list being part of every key.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.materialize import Scratch
from strataq.skew import look_up

NONE = "none"
#: similarity of an abbreviation to its word, weight of a common word
ABBREVIATED, COMMON = 0.75, 0.001
#: letters of a word that may hold two edits
LONG = 8

# fixed values: words around a name that say nothing about which entry is meant
NOISE = {
    "license": "a all by file files for in is it lic license licensed of on see spdx text the under uses using v ver version with".split(),
    "algorithm": "a algo algorithm and authentication bit bits by cipher default digest encryption exchange for hash hashing handshake in is key legacy mac mode of over signature signing tag the uses using with".split(),
}
# fixed values: spellings of one word
SAME_WORD = {"licence": "license"}
#: fields whose numbers have decimals; elsewhere a dot parts two numbers
DECIMALS = {"license"}
# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнԛԝ", "aeopcyxijsdhkmtbhqw")) | dict(zip("АВЕКМНОРСТУХІЈЅ", "ABEKMHOPCTYXIJS")) | dict(zip("οανικρτυ", "oavikptu"))


def _fold_table() -> tuple[str, str]:
    """Single characters and what they are compared as: full-width forms, letters
    with accents, look-alikes, dashes."""
    table = dict(LOOKALIKE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]):
        base = unicodedata.normalize("NFKD", c)[0]
        if base != c and base.isascii():
            table[c] = base
    table |= dict.fromkeys("‐‑‒–—―−", "-") | {"ß": "s", "ø": "o", "Ø": "o", "ł": "l", "đ": "d", "ı": "i"}
    return "".join(table), "".join(table.values())


def fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, *_fold_table()), r"[\p{M}\p{Cf}]", ""))


def tokens(text: Column) -> Column:
    """Runs of letters, and numbers, with their decimals where the row's ``kind``
    has any; a trailing .0 and a v written onto a word before a number are left out."""
    parted = F.regexp_replace(fold(text), r"(?<=\p{L})v(?=\p{N})", " ")
    whole = F.regexp_extract_all(parted, F.lit(r"(\p{L}+|\p{N}+(?:\.\p{N}+)*)"), 1)
    found = F.when(F.col("kind").isin(*DECIMALS), whole).otherwise(F.regexp_extract_all(parted, F.lit(r"(\p{L}+|\p{N}+)"), 1))
    same = F.create_map(*[F.lit(x) for kv in SAME_WORD.items() for x in kv])
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(same, t), F.regexp_replace(t, r"(?:\.0+)+$", "")))


def is_common(word: Column, kind: Column) -> Column:
    out = F.lit(False)
    for k, words in NOISE.items():
        out = out | ((kind == k) & word.isin(words))
    return out


def _deletions(token: Column) -> Column:
    """The token and all forms with one letter less."""
    one = F.transform(F.sequence(F.lit(1), F.char_length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.char_length(token))))
    return F.array_distinct(F.concat(F.array(token), one))


def _two_deletions(token: Column) -> Column:
    """The token and all forms with one or two letters less."""
    return F.array_distinct(F.flatten(F.transform(_deletions(token), _deletions)))


def surfaces(entries: DataFrame) -> DataFrame:
    """entries: (kind, ref_id, title, version or null). Out: (kind, surface, ref_id,
    words), words being the token set of one way to name the entry."""
    spelled = entries.select("kind", "ref_id", tokens(F.col("ref_id")).alias("id_"), tokens(F.col("title")).alias("title_"), F.coalesce(tokens(F.col("version")), F.array().cast("array<string>")).alias("version_"))
    stem = F.array_except("id_", "version_")
    has = F.size("version_") > 0
    way = lambda words, bare: F.struct(words.alias("w"), F.lit(bare).alias("bare"))
    ways = spelled.select("kind", "ref_id", F.explode(F.array(way(F.col("id_"), False), way(F.concat("title_", "version_"), False), way(F.when(has, F.col("title_")), True), way(F.when(has, stem), True))).alias("_s"))
    ways = ways.select("kind", "ref_id", F.array_sort(F.array_distinct("_s.w")).alias("words"), "_s.bare").where("words is not null and size(words) > 0")
    # a name without its version stands for an entry only if no other entry shares it
    shared = F.count("*").over(Window.partitionBy("kind", "words"))
    ways = ways.withColumn("_n", shared).where("not bare or _n = 1").groupBy("kind", "words").agg(F.min("ref_id").alias("ref_id"))
    return ways.withColumn("surface", F.concat_ws(" ", "words"))


def vocabulary(names: DataFrame) -> DataFrame:
    """(kind, word, weight): idf of each word over the names of its list."""
    total = {r.kind: r.n for r in names.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # one row per list
    if not total:
        return names.select("kind", F.col("surface").alias("word"), F.lit(0.0).alias("weight"))
    n = F.element_at(F.create_map(*[F.lit(x) for kv in total.items() for x in kv]), F.col("kind"))
    words = names.select("kind", F.explode("words").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("_df"))
    return words.select("kind", "word", (F.log(1 + n / F.col("_df")) * F.when(is_common(F.col("word"), F.col("kind")), COMMON).otherwise(1.0)).alias("weight"))


def repair(asked: DataFrame, entries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kind, token, word, weight, sim): the vocabulary words that each distinct
    token outside the vocabulary may mean, those at the least distance."""
    codes = entries.select("kind", F.explode(tokens(F.col("ref_id"))).alias("word")).distinct().where("char_length(word) <= 5")
    words = vocab.where(r"word rlike '^\\p{L}{3,}$'").join(codes, ["kind", "word"], "left_anti")
    longest = words.agg(F.coalesce(F.max(F.char_length("word")), F.lit(0))).first()[0]
    beginnings = F.transform(F.sequence(F.lit(3), F.char_length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    offered = words.select("kind", "word", "weight", F.explode(F.when(F.char_length("word") >= LONG, _two_deletions(F.col("word"))).otherwise(_deletions(F.col("word")))).alias("key"), F.lit(False).alias("short"))
    offered = offered.unionByName(words.where("char_length(word) > 3").select("kind", "word", "weight", F.explode(beginnings).alias("key"), F.lit(True).alias("short")))
    # a token more than two letters longer than the longest word is two edits away from none
    letters = asked.where(r"token rlike '^\\p{L}{3,}$'").where(F.char_length("token") <= longest + 2)
    keys = letters.select("kind", "token", F.explode(F.when(F.char_length("token") >= LONG - 2, _two_deletions(F.col("token"))).otherwise(_deletions(F.col("token")))).alias("key"))
    edits, long = F.levenshtein("token", "word"), F.char_length("word") >= LONG
    same_start = F.substring("token", 1, 1) == F.substring("word", 1, 1)
    # one swap of neighbours is two edits on the same letters
    swap = (edits == 2) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("word", "")))
    near = ~F.col("short") & (same_start | long) & ((edits <= 1) | swap | (long & (edits <= 2)))
    begins = F.col("short") & (F.col("key") == F.col("token"))
    cost = F.when(F.col("short"), F.lit(3)).when(swap, F.lit(1)).otherwise(edits)
    pairs = keys.join(offered.hint("merge"), ["kind", "key"]).where(near | begins).select("kind", "token", "word", "weight", cost.alias("cost")).distinct()
    least = pairs.groupBy("kind", "token").agg(F.min("cost").alias("_least"))
    sim = F.when(F.col("cost") == 3, F.lit(ABBREVIATED)).otherwise(1 - F.col("cost") / F.greatest(F.char_length("word"), F.char_length("token")))
    return pairs.join(least.hint("merge"), ["kind", "token"]).where("cost = _least").select("kind", "token", "word", "weight", sim.alias("sim"))


def rank(signatures: DataFrame, names: DataFrame, vocab: DataFrame) -> DataFrame:
    """signatures: (kind, sig, elements), an element being (common, options) with
    the words (word, weight, sim) that a token may mean. Out: (kind, sig, ref_id,
    score, whole) of the best name."""
    words = names.select("kind", "surface", "ref_id", F.explode("words").alias("word")).join(vocab, ["kind", "word"])
    held = words.groupBy("kind", "surface", "ref_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("_weights"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    index = held.select("*", F.explode(F.map_keys("_weights")).alias("word"))
    telling = F.filter("elements", lambda e: ~e["common"])
    weigh = lambda e: F.array_max(F.transform(e["options"], lambda o: o["weight"]))
    rarest = F.array_max(F.transform(F.when(F.size(telling) > 0, telling).otherwise(F.col("elements")), lambda e: F.struct(weigh(e).alias("w"), e["options"].alias("options"))))
    # any name that holds all of the value holds its rarest token
    asked = signatures.select("kind", "sig", "elements", F.explode(F.array_distinct(F.transform(rarest["options"], lambda o: o["word"]))).alias("word"))
    pairs = asked.join(index.hint("merge"), ["kind", "word"]).drop("word")
    hit = lambda e: F.array_max(F.transform(F.filter(e["options"], lambda o: F.map_contains_key("_weights", o["word"])), lambda o: F.struct((o["sim"] * o["weight"] * o["weight"]).alias("dot"), o["word"].alias("word"))))
    pairs = pairs.withColumn("_hits", F.transform("elements", lambda e: F.struct(e["common"].alias("common"), hit(e).alias("hit"))))
    add = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    dot, own = add(F.transform("_hits", lambda h: h["hit"]["dot"])), F.sqrt(add(F.transform("elements", lambda e: weigh(e) * weigh(e))))
    left_over = F.exists("_hits", lambda h: ~h["common"] & h["hit"].isNull())
    lacking = F.array_except(F.map_keys("_weights"), F.transform(F.filter("_hits", lambda h: h["hit"].isNotNull()), lambda h: h["hit"]["word"]))
    # a name of common words needs all of them, any other name only the rest
    told = F.filter(F.map_keys("_weights"), lambda w: ~is_common(w, F.col("kind")))
    missing = F.when(F.size(told) > 0, F.size(F.array_intersect(lacking, told))).otherwise(F.size(lacking)) > 0
    scored = pairs.select("kind", "sig", "surface", "ref_id", (dot / (own * F.col("_norm"))).alias("score"), (~left_over & ~missing).alias("whole"))
    return scored.groupBy("kind", "sig").agg(F.max_by(F.struct("ref_id", "score", "whole"), F.struct(F.round("score", 9), "surface")).alias("b")).select("kind", "sig", "b.*")


def map_values(values: DataFrame, entries: DataFrame, checked: bool = True) -> DataFrame:
    """values: (kind, record_id, raw); entries: (kind, ref_id, title, version). Out:
    (kind, record_id, raw, ref_id) of every value that isn't null, blank or literally
    an entry; ref_id is 'none' where no entry is meant (with ``checked`` off: where
    no name shares a telling token). Repeated rows come out as often as they go in."""
    scratch = Scratch(values.sparkSession, "canonical")
    names = scratch.put(surfaces(entries))
    vocab = scratch.put(vocabulary(names))
    exact = entries.select("kind", F.col("ref_id").alias("raw")).distinct()
    asked = values.where(F.col("raw").rlike(r"[^\s\p{Z}]")).join(exact, ["kind", "raw"], "left_anti").withColumn("raw_key", F.md5("raw"))
    distinct = asked.groupBy("kind", "raw_key").agg(F.count("*").alias("n"), F.first("raw").alias("raw"))
    # a name written in one piece or split elsewhere is recognised by its letters and numbers alone
    kind = F.col("kind")
    glue = lambda t: F.concat_ws("", F.filter(t, lambda w: ~is_common(w, kind)))
    glued = entries.withColumn("of", tokens(F.col("ref_id"))).groupBy("kind", glue(F.col("of")).alias("glue")).agg(F.first("of").alias("of"), F.count_distinct("ref_id").alias("_c")).where("_c = 1 and glue <> ''").drop("_c")
    cut = distinct.withColumn("t", tokens(F.col("raw"))).withColumn("glue", glue(F.col("t"))).join(glued, ["kind", "glue"], "left")
    cut = scratch.put(cut.select("kind", "raw_key", "n", F.array_distinct(F.coalesce("of", "t")).alias("t")))
    loose = cut.select("kind", "raw_key", F.explode("t").alias("token"))
    seen = scratch.put(loose.groupBy("kind", "token").agg(F.count("*").alias("n")))
    known = seen.join(vocab.withColumnRenamed("word", "token").hint("merge"), ["kind", "token"]).select("kind", "token", F.col("token").alias("word"), "weight", F.lit(1.0).alias("sim"))
    lost = seen.where(~is_common(F.col("token"), kind)).join(known.select("kind", "token").hint("merge"), ["kind", "token"], "left_anti")
    options = known.unionByName(repair(lost, entries, vocab)).groupBy("kind", "token").agg(F.array_sort(F.collect_list(F.struct("word", "weight", "sim"))).alias("options"))
    meant = scratch.put(seen.join(options.hint("merge"), ["kind", "token"], "left").withColumn("common", is_common(F.col("token"), kind)))
    elements = look_up(loose, meant, ["kind", "token"], "n").groupBy("kind", "raw_key").agg(F.array_sort(F.collect_set(F.when(F.col("options").isNotNull(), F.struct("common", "options")))).alias("elements"), F.count_if(F.col("options").isNull() & ~F.col("common")).alias("_unknown"))
    # what no name has can't be made good by a better rank
    mended = scratch.put(elements.where(f"{'_unknown = 0 and ' if checked else ''}size(elements) > 0").select("kind", "raw_key", "elements", F.md5(F.to_json("elements")).alias("sig")))
    signatures = scratch.put(mended.groupBy("kind", "sig").agg(F.first("elements").alias("elements"), F.count("*").alias("n")))
    best = rank(signatures, names, vocab)
    found = scratch.put(signatures.select("kind", "sig", "n").join((best.where("whole") if checked else best).hint("merge"), ["kind", "sig"]).select("kind", "sig", "n", "ref_id"))
    told = look_up(mended.select("kind", "raw_key", "sig"), found, ["kind", "sig"], "n").select("kind", "raw_key", "ref_id")
    answer = scratch.put(cut.select("kind", "raw_key", "n").join(told.hint("merge"), ["kind", "raw_key"], "left").select("kind", "raw_key", "n", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id")))
    return look_up(asked, answer, ["kind", "raw_key"], "n").select("kind", "record_id", "raw", "ref_id")


def license_entries(ref: DataFrame) -> DataFrame:
    return ref.select(F.lit("license").alias("kind"), F.col("license_id").alias("ref_id"), "title", F.col("license_version").alias("version"))


def algorithm_entries(ref: DataFrame) -> DataFrame:
    return ref.select(F.lit("algorithm").alias("kind"), F.col("algorithm").alias("ref_id"), "title", F.lit(None).cast("string").alias("version"))


def mapped_fields(packages: DataFrame, usages: DataFrame, licenses: DataFrame, algorithms: DataFrame) -> DataFrame:
    """(field, record_id, raw, ref_id) of package_info.license and crypto_usage.algorithm."""
    values = packages.select(F.lit("license").alias("kind"), F.col("info_id").alias("record_id"), F.col("license").alias("raw"))
    values = values.unionByName(usages.select(F.lit("algorithm").alias("kind"), F.col("usage_id").alias("record_id"), F.col("algorithm").alias("raw")))
    return map_values(values, license_entries(licenses).unionByName(algorithm_entries(algorithms))).withColumnRenamed("kind", "field")
