"""Record linkage: duplicates by key and by title similarity, conflicts, merges, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.wording import normal_title, surname
from titerlake.sources.adapters import dealt


def title_tokens(sources: DataFrame) -> DataFrame:
    """``source_id, title, who, tokens`` of titles with a token: normal title, surname (null is empty), sorted tokens."""
    title = normal_title(F.col("title"))
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(title, " "), lambda t: t != "")))
    who = F.coalesce(surname(F.col("authors")), F.lit(""))
    return sources.select("source_id", title.alias("title"), who.alias("who"), tokens.alias("tokens")).where(F.size("tokens") > 0)


#: How many tokens make a signature of two sets, the larger of which has at most so many tokens; of still larger ones a single token does (fixed values).
SIGNATURES = ((40, 3), (200, 2))


def _least_shared(n: Column, least: float) -> Column:
    """How many of its ``n`` tokens a set shares at least with one that is alike by ``least``."""
    return F.ceil(n * least - 1e-9).cast("int")


def rarest_first(sets: DataFrame, counted: DataFrame, least: float) -> DataFrame:
    """``sets`` (of the column ``tokens``, sorted, and others that tell the sets apart) with ``ordered``: the tokens by ``counted(token, df)``, unknown ones first.

    Sets that hold fewer counted tokens than they share with any set alike by ``least`` are left out.
    """
    keys = sets.columns
    each = sets.withColumn("token", F.explode("tokens")).join(counted, "token")
    known = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])  # the tokens of one title
    rows = each.groupBy(*keys).agg(known.alias("known")).where(F.size("known") >= _least_shared(F.size("tokens"), least))
    return rows.select(*keys, F.concat(F.array_except("tokens", "known"), "known").alias("ordered"))


def signatures(ordered: Column, least: float) -> Column:
    """Hashes of a set of tokens in an order common to all sets; two sets alike by ``least`` share one.

    Of the tokens that two such sets share, the first ``k`` lie among the first ``n - s + k`` of either, if that one has ``n``
    and shares ``s`` or more. All choices of ``k`` of these are signatures, for every ``k`` that a partner's size may ask for.
    """
    n = F.size(ordered)

    def level(x: Column) -> Column:
        most = F.when(x <= SIGNATURES[0][0], SIGNATURES[0][1]).when(x <= SIGNATURES[1][0], SIGNATURES[1][1]).otherwise(1)
        return F.least(most, F.greatest(_least_shared(x, least), F.lit(1)))

    def choices(k: int) -> Column:
        first = F.slice(ordered, 1, n - _least_shared(n, least) + k)
        made = F.transform(first, lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.lit(k), x).alias("h")))
        for _ in range(k - 1):
            more = lambda m: F.transform(F.slice(first, m["i"] + 2, F.size(first)), lambda x, j: F.struct((m["i"] + j + 1).alias("i"), F.xxhash64(m["h"], x).alias("h")))
            made = F.flatten(F.transform(made, more))
        return F.transform(made, lambda m: m["h"])

    wanted = F.array_distinct(F.transform(F.sequence(n, F.floor(n / least + 1e-9).cast("int")), level))
    none = F.array().cast("array<bigint>")
    return F.concat(*[F.when(F.array_contains(wanted, k), choices(k)).otherwise(none) for k in (1, 2, 3)])


def likeness(x: str, y: str) -> Column:
    """Jaccard similarity of two columns of distinct tokens."""
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


def nearest_holders(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """``tokens, source_id, s`` of each set of ``wanted(tokens)`` that is held by a set of ``classes(tokens, source_id)`` with as many tokens or one more.

    It is the equal set, else the one of the least id, and ``s`` their Jaccard similarity. A set's key is the XOR of its tokens' hashes, so that
    of a set without one token follows from both hashes, and the rows that meet grow with the tokens. What meets is compared in full; a set
    that lost its holder to another of the same key is not returned.
    """
    key = F.aggregate("tokens", F.lit(0).cast("long"), lambda h, t: h.bitwiseXOR(F.xxhash64(t)))
    keyed = classes.select("source_id", "tokens", key.alias("whole"))
    held = keyed.select("source_id", "whole", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))).alias("left_out"))
    more = F.col("left_out").isNotNull()
    k = F.when(more, F.col("whole").bitwiseXOR(F.xxhash64("left_out"))).otherwise(F.col("whole"))
    first = held.select(k.alias("key"), F.struct(more.alias("more"), "source_id", "whole").alias("first")).groupBy("key").agg(F.min("first").alias("first"))
    met = wanted.withColumn("key", key).join(first, "key").select("tokens", "first.source_id", "first.whole")
    theirs = keyed.select("source_id", "whole", F.col("tokens").alias("held"))
    holds = (F.size(F.array_except("tokens", "held")) == 0) & (F.size("held") <= F.size("tokens") + 1)
    return met.join(theirs, ["source_id", "whole"]).where(holds).select("tokens", "source_id", likeness("tokens", "held").alias("s"))


def title_pairs(sources: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs ``a, b`` of classes with equal first-author surname and title-token Jaccard of ``least`` or more.

    Sources with the same surname and the same tokens are one class, named by its smallest id, so a title with many
    copies is one row. ``signatures`` of rarest-first tokens block the join: titles that share a few words meet only if
    these are three of their rarest, so what meets grows with what is alike, not with the square of a word's titles.
    Titles without a token pair with nothing; sources without a surname share an empty one.
    """
    rows = title_tokens(sources)
    classes = rows.groupBy("who", "tokens").agg(F.min("source_id").alias("id"), F.count("*").alias("copies"))
    counted = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    signed = rarest_first(classes, counted, least).select("id", "who", "copies", "tokens", F.explode(signatures(F.col("ordered"), least)).alias("signature"))
    a, b = (signed.select(F.col("id").alias(s), "who", F.col("copies").alias(f"copies_{s}"), F.col("tokens").alias(f"t{s}"), "signature") for s in "ab")
    pairs = a.join(b, ["who", "signature"]).where(F.col("a") < F.col("b")).withColumn("score", likeness("ta", "tb")).where(F.col("score") >= least)
    return pairs.select("a", "b", "copies_a", "copies_b", F.round("score", 4).alias("similarity")).distinct()


def same_text_groups(sources: DataFrame) -> DataFrame:
    """Content-hash duplicates: smallest id, number of copies."""
    return sources.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("source_id").alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") > 1)


def conflict_groups(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows disagree on ``value``: how many rows and how many different values they have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(value).alias("n_values")).where(F.col("n_values") > 1)


def link_parents(obs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Subgroup rows with ``parent_value``, the least value of a primary row with the same keys; null where none has."""
    parents = obs.where(F.col("estimate_type") == "primary").groupBy(*keys).agg(F.min(value).alias("parent_value"))
    return obs.where(F.col("estimate_type") == "subgroup").join(parents, keys, "left")


#: Passages up to this number are looked up inside the texts' rows; more are joined by key.
FEW_PASSAGES = 20000


def contained_passages(docs: DataFrame, passages: DataFrame, width: int = 8) -> DataFrame:
    """``doc_id, item_id`` where a text holds a whole passage, blanks alike. A passage without a word is in no text.

    A passage is looked up by its first ``width`` words (all of a shorter one) among all word windows of that length, then
    checked in full. Where the passages are few, a text's windows are matched in its own row, so that texts are
    never shuffled; else windows and passages join by key, and only texts with a hit come back.
    """
    def squeezed(c: str) -> Column:
        return F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))

    def holds(whole: str, passage: str) -> Column:
        return F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), passage, F.lit(" ")))

    wanted = passages.select("item_id", squeezed("text").alias("passage")).where(F.length("passage") > 0).withColumn("words", F.split("passage", " "))
    wanted = wanted.select("item_id", "passage", F.least(F.size("words"), F.lit(width)).alias("n"), F.xxhash64(F.slice("words", 1, width)).alias("key"))
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most ``width``
    texts = docs.select("doc_id", squeezed("text").alias("whole")).where(F.length("whole") > 0).withColumn("words", F.split("whole", " "))

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - n + 1)
        return F.when(F.size("words") >= n, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, n)))).otherwise(F.array().cast("array<bigint>"))

    keys = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[windows(n) for n in lengths]))
    known = [r["key"] for r in wanted.select("key").distinct().limit(FEW_PASSAGES + 1).collect()]
    if len(known) <= FEW_PASSAGES:
        hits = texts.select("doc_id", "whole", F.explode(F.array_intersect(keys, F.array(*map(F.lit, known)).cast("array<bigint>"))).alias("key"))
        found = hits.join(F.broadcast(wanted), "key")  # as many passages as were just counted
    else:
        found = texts.select("doc_id", F.explode(keys).alias("key")).join(wanted, "key").join(texts.select("doc_id", "whole"), "doc_id")
    return found.where(holds("whole", "passage")).select("doc_id", "item_id")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` take the place of those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def merge_preview(facts: DataFrame, pairs: DataFrame, tasks: int = 0) -> DataFrame:
    """Facts of sources ``a`` and ``b`` (rows of ``pairs``) that state the same thing: equal disease, province, year and type.

    Empty text and year 0 count as null, and null equals null. Every pair of facts is a row. The sources join first, so
    the other keys only split the few facts of two sources. Both joins take ``tasks`` tasks, if these are more than the session's.
    """
    keys = {"disease": "", "province": "", "collection_year": 0, "data_type": ""}
    same = [F.coalesce(F.col(k), F.lit(empty)).alias(k) for k, empty in keys.items()]
    x, y = (facts.select(F.col("source_id").alias(s), *same, F.col("value").alias(f"value_{s}"), F.col("sample_size").alias(f"size_{s}")) for s in "ab")
    both = dealt(pairs.select("a", "b"), tasks, "a").distinct().join(dealt(x, tasks, "a"), "a").join(dealt(y, tasks, "b", *keys), ["b", *keys])
    return both.select("a", "b", *[F.nullif(F.col(k), F.lit(empty)).alias(k) for k, empty in keys.items()], "value_a", "size_a", "value_b", "size_b")


def first_of_passes(passes: list[DataFrame], keys: list[str], id_col: str, tasks: int = 0) -> DataFrame:
    """Union of passes with one row a key (null equals null): the first pass and its least id that hold it, and how many rows did.

    The least (pass, id) is an aggregate, so rows are combined before the shuffle. Where ``tasks`` are more than the session's, rows
    are dealt out to so many by the keys that are no floating-point numbers (which Spark groups in a form of its own).
    """
    ranked = [rows.select(*keys, F.struct(F.lit(i).alias("pass"), F.col(id_col).alias(id_col)).alias("first")) for i, rows in enumerate(passes, 1)]
    whole = ranked[0]
    for rows in ranked[1:]:
        whole = whole.unionByName(rows)
    exact = [k for k, kind in whole.dtypes if k in keys and kind not in ("float", "double")]
    least = (dealt(whole, tasks, *exact) if exact else whole).groupBy(*keys).agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return least.select(*keys, "first.pass", f"first.{id_col}", "n")
