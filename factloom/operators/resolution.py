"""Resolution of mentions over the stored values of many tables.

No mention is compared with all values.  Scores imply that two strings share a fixed
share of their trigrams or characters, so candidates come from a prefix index: the
pieces of a string are put in one order over the corpus, rarest first, and strings
that are alike enough must share one of their first pieces and have sizes within a fixed factor.  The order
needs the frequency of each piece, of which there are few: normal forms are made of 37 characters.

Every step is a join or an aggregate; a mention's spellings become clusters by labels that
travel along links.  Nothing is collected but counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import similarity as s
from factloom.functions.text import collapsed_runs, is_reference, normalised, trigrams, without_noise
from factloom.operators.profile import reference_columns, reference_key, value_catalogue, vocabulary_columns
from factloom.session import settled

#: Blends of sequence and trigram likeness of at least the key have this overlap of trigrams, as the sequence part is 1 at most.
_GRAMS_OF = {x: (x - s.SEQUENCE_WEIGHT) / s.TRIGRAM_WEIGHT for x in (s.BAND * s.RESOLVED, s.SAME_CLUSTER)}
#: Sequence ratios of at least the key share this part (Jaccard) of their characters, counted with their repeats.
_CHARS_OF = {x: x / (2 - x) for x in (s.NEAR_VARIANT, s.MODERATE_LEAST)}
_EPS = 1e-9


def catalogue_of(tables: dict[str, DataFrame], bound: int | None = None) -> DataFrame:
    """The value catalogue of all vocabulary columns of some tables: table_name, column_name, value, match_kind, stored."""
    out = None
    for name, df in tables.items():
        if columns := vocabulary_columns(df):
            found = (value_catalogue(df, columns) if bound is None else value_catalogue(df, columns, bound)).select(F.lit(name).alias("table_name"), "*")
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no table has a column of values")
    return out


def references_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The values of all reference columns of some tables: table_name, column_name, value."""
    out = None
    for name, df in tables.items():
        for column in reference_columns(df):
            found = df.where(F.col(f"`{column}`").isNotNull()).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.col(f"`{column}`").alias("value")).distinct()
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no table has a column of references")
    return out


def characters(text: Column) -> Column:
    """The characters of a text, each with its number among equal ones: a set for a multiset."""
    chars = F.array_sort(F.split(text, ""))
    numbered = F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))
    return F.filter(numbered, lambda c: F.length(c) > 1)


def _with_prefix(strings: DataFrame, frequencies: DataFrame, share: float) -> DataFrame:
    """``text``, ``n``, ``items`` and a row for each ``item`` of the prefix; strings have text and items."""
    rows = strings.select("text", F.explode("items").alias("item")).join(F.broadcast(frequencies), "item", "left")
    ordered = rows.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("frequency", F.lit(0)).alias("f"), "item"))).alias("o"))
    n = F.size("o")
    first = F.slice("o", 1, n - F.ceil(n * share - _EPS).cast("int") + 1)
    return ordered.select("text", n.alias("n"), F.transform("o", lambda x: x["item"]).alias("items"), F.explode(first).alias("p")).select("text", "n", "items", F.col("p.item").alias("item"))


def alike_sets(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of texts whose item sets have a Jaccard overlap of ``share`` or more; both frames have text (distinct) and items (distinct, not empty)."""
    frequencies = right.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("frequency"))
    x, y = (_with_prefix(df, frequencies, share).select(*[F.col(c).alias(f"{c}_{side}") if c != "item" else "item" for c in ("text", "n", "items", "item")]) for df, side in ((left, "a"), (right, "b")))
    both = x.join(y, (x["item"] == y["item"]) & (F.col("n_a") >= share * F.col("n_b") - _EPS) & (F.col("n_b") >= share * F.col("n_a") - _EPS))
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(common * (1 + share) >= share * (F.col("n_a") + F.col("n_b")) - _EPS).select(F.col("text_a").alias("a"), F.col("text_b").alias("b")).distinct()


def _views(texts: DataFrame, views: list) -> list[DataFrame]:
    return [texts.select("text", v(F.col("text")).alias("items")).where(F.size("items") > 0) for v in views]


_PLAIN, _COLLAPSED = trigrams, lambda t: trigrams(collapsed_runs(t))
_CHARS, _COLLAPSED_CHARS = characters, lambda t: characters(collapsed_runs(t))


def alike(left: DataFrame, right: DataFrame, shares: list[tuple]) -> DataFrame:
    """Pairs that are alike in one of several views (of items, share); frames have text."""
    out = None
    for view, share in shares:
        found = alike_sets(_views(left, [view])[0], _views(right, [view])[0], share)
        out = found if out is None else out.union(found)
    return out.distinct()


def _udf(kind: str, f):
    """A pandas UDF of two text columns; the functions are those that the plain form uses."""

    @F.pandas_udf(kind)
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="bool" if kind == "boolean" else "float64")

    return over


def candidate_pairs(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs (a, b) of a mention's and a value's normal form that may score BAND * RESOLVED or more; both frames have text.

    A score comes from the whole strings, which then share trigrams, or from tokens: then
    each longer token of the mention is like a token of the value.  Tokens are few, so
    they are compared with tokens first; of a mention's tokens the one whose likes
    occur in the fewest values then finds the values.
    """
    t = _GRAMS_OF[s.BAND * s.RESOLVED]
    whole = alike(asked, forms, [(_PLAIN, t), (_COLLAPSED, t)])
    longer = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= s.LEAST_CHARS))
    of_mention = asked.select("text", F.explode(longer(F.col("text"))).alias("token"))
    of_value = forms.select(F.col("text").alias("b"), F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    least = s.MODERATE_LEAST
    near = alike(of_mention.select(F.col("token").alias("text")).distinct(), of_value.select(F.col("token").alias("text")).distinct(), [(_CHARS, _CHARS_OF[least]), (_COLLAPSED_CHARS, _CHARS_OF[least]), (_PLAIN, least)])
    near = near.where(_udf("boolean", lambda x, y: s.token_likeness(x, y) >= least)("a", "b")).select(F.col("a").alias("token"), F.col("b").alias("like"))
    frequency = of_value.groupBy(F.col("token").alias("like")).agg(F.count("*").alias("values"))
    reach = near.join(frequency, "like").groupBy("token").agg(F.sum("values").alias("values"))
    tokens = of_mention.join(reach, "token", "left")
    rarest = tokens.groupBy("text").agg(F.min(F.struct(F.coalesce("values", F.lit(0)).alias("values"), "token")).alias("m")).where("m.values > 0")
    by_token = rarest.select(F.col("text").alias("a"), F.col("m.token").alias("token")).join(near, "token").join(of_value.select("b", F.col("token").alias("like")), "like").select("a", "b")
    return whole.union(by_token).distinct()


def _near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    found = alike(left, right, [(_CHARS, _CHARS_OF[s.NEAR_VARIANT])])
    return found.where(_udf("boolean", s.near_variant)("a", "b"))


def variant_groups(scored: DataFrame, forms: DataFrame, order: DataFrame) -> DataFrame:
    """The spellings around each mention's best: mention, text.

    ``scored`` has mention, m (its normal form), text and score.  Those within BAND of the best are in; near variants of them
    join, and near variants of those that stand later in the catalogue (``order``: text, place), as one pass over it finds them.
    """
    best = scored.groupBy("mention").agg(F.max("score").alias("top")).where(F.col("top") >= s.RESOLVED)
    band = scored.join(best, "mention").where(F.col("score") >= s.BAND * F.col("top"))
    group = settled(band.select("mention", "text", F.lit(None).cast("string").alias("place")))
    frontier = group
    while True:
        near = _near_pairs(frontier.select("text").distinct(), forms)
        met = frontier.join(near.select(F.col("a").alias("text"), "b"), "text").join(order.select(F.col("text").alias("b"), F.col("place").alias("at")), "b").where("place is null or at > place")
        new = met.groupBy("mention", F.col("b").alias("text")).agg(F.min("at").alias("place")).join(group.select("mention", "text"), ["mention", "text"], "left_anti")
        frontier = settled(new)
        if frontier.isEmpty():
            return group.select("mention", "text")
        group = settled(group.unionByName(frontier))


def clusters(group: DataFrame) -> DataFrame:
    """The cluster of each spelling of a mention (mention, text, cluster: its least spelling).

    Spellings are linked if their whole score is SAME_CLUSTER or more or they are near variants.  Each takes the least label of
    its links and then that label's own label, until none changes.
    """
    texts = group.select("text").distinct()
    t = _GRAMS_OF[s.SAME_CLUSTER]
    same = alike(texts, texts, [(_PLAIN, t), (_COLLAPSED, t)]).where("a < b")
    linked = same.where(_udf("boolean", lambda x, y: s.whole_score(x, y) >= s.SAME_CLUSTER)("a", "b")).union(_near_pairs(texts, texts).where("a < b")).distinct()
    links = settled(linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = group.select("mention", "text", F.col("text").alias("cluster"))
    while True:
        there = labels.select("mention", F.col("text").alias("b"), F.col("cluster").alias("other"))
        around = labels.select("mention", "text").join(links.select(F.col("a").alias("text"), "b"), "text").join(there, ["mention", "b"]).groupBy("mention", "text").agg(F.min("other").alias("least"))
        near = labels.join(around, ["mention", "text"], "left").select("mention", "text", F.col("cluster").alias("was"), F.least("cluster", "least").alias("cluster"))
        jump = there.withColumnsRenamed({"b": "cluster", "other": "further"})
        moved = settled(near.join(jump, ["mention", "cluster"], "left").select("mention", "text", "was", F.least("cluster", "further").alias("cluster")))
        if moved.where("was <> cluster").isEmpty():
            return moved.select("mention", "text", "cluster")
        labels = moved.drop("was")


_OUT = ("mention", "status", "kind", "table_name", "column_name", "values", "match_kind", "score", "candidates")


def _rows(df: DataFrame, status: str, kind: str) -> DataFrame:
    empty = {"table_name": "string", "column_name": "string", "values": "array<string>", "match_kind": "string", "score": "double", "candidates": "array<string>"}
    return df.select("mention", F.lit(status).alias("status"), F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def _by_reference(asked: DataFrame, references: DataFrame) -> DataFrame:
    """References are only found exactly; one that several stored values have is ambiguous."""
    held = asked.join(references.withColumn("key", reference_key(F.col("value"))), "key")
    counted = held.groupBy("mention").agg(F.array_sort(F.collect_set("value")).alias("candidates"))
    several = counted.where(F.size("candidates") > 1)
    one = held.join(counted.where(F.size("candidates") == 1).select("mention"), "mention", "left_semi")
    matches = one.groupBy("mention", "table_name", "column_name").agg(F.array_sort(F.collect_set("value")).alias("values"), F.lit("equals").alias("match_kind"), F.lit(1.0).alias("score"))
    missing = asked.join(counted, "mention", "left_anti")
    return _rows(matches, "resolved", "reference").unionByName(_rows(several, "ambiguous", "reference")).unionByName(_rows(missing, "not_found", "reference"))


def _by_value(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """asked: mention, m (its normal form)."""
    values = settled(catalogue.select("table_name", "column_name", "value", "match_kind", without_noise(normalised(F.col("value"))).alias("text")).where("text <> ''"))
    forms = values.select("text").distinct()
    place = values.groupBy("text").agg(F.min(F.concat_ws("\u0001", "table_name", "column_name", "value")).alias("place"))
    wanted = asked.where(F.length(F.replace("m", F.lit(" "), F.lit(""))) >= s.LEAST_CHARS)
    pairs = candidate_pairs(wanted.select(F.col("m").alias("text")).distinct(), forms)
    scores = pairs.withColumn("score", _udf("double", s.score)("a", "b"))
    scored = settled(wanted.join(scores.where(F.col("score") >= s.BAND * s.RESOLVED - _EPS).withColumnsRenamed({"a": "m", "b": "text"}), "m"))
    group = variant_groups(scored, forms, place)
    found = clusters(group).join(wanted, "mention")
    # near variants that joined have scores of their own, under those of the band
    known = found.join(scored.select("mention", "text", "score"), ["mention", "text"], "left")
    members = settled(known.withColumn("score", F.coalesce("score", _udf("double", s.score)("m", "text"))).drop("m"))
    scored_clusters = members.groupBy("mention", "cluster").agg(F.max("score").alias("best"))
    ranked = scored_clusters.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("minus"), "cluster"))).alias("c"))
    # the best is that of the greatest score, of equal ones that of the greatest least spelling
    leaders = ranked.select("mention", F.size("c").alias("n"), F.expr("array_max(transform(c, x -> struct(-x.minus as best, x.cluster as cluster)))").alias("first"), F.expr("element_at(c, 2).minus").alias("second"))
    clear = (F.col("first.best") >= s.DOMINANT) & (-F.col("second") <= F.col("first.best") - s.DOMINANT_LEAD)
    decided = leaders.where((F.col("n") == 1) | clear).select("mention", F.col("first.cluster").alias("cluster"))
    chosen = members.join(decided, ["mention", "cluster"]).join(values, "text")
    kind = F.when(F.max((F.col("match_kind") == "contains").cast("int")) == 1, "contains").otherwise("equals").alias("match_kind")
    matches = chosen.groupBy("mention", "table_name", "column_name").agg(F.array_sort(F.collect_set("value")).alias("values"), kind, F.max("score").alias("score"))
    # one spelling for each cluster; plain ones before compound ones
    compound = F.contains("value", F.lit(",")).cast("int")
    shown = members.join(decided, "mention", "left_anti").join(values, "text").groupBy("mention", "cluster").agg(F.min(F.struct(compound.alias("compound"), (-F.col("score")).alias("minus"), "value")).alias("v"))
    listed = shown.groupBy("mention").agg(F.min("v.compound").alias("least"), F.array_sort(F.collect_list(F.struct("v.minus", "v.value", "v.compound"))).alias("v"))
    asked_back = listed.select("mention", F.expr(f"slice(transform(filter(v, x -> x.compound = least), x -> x.value), 1, {s.LABELS})").alias("candidates"))
    missing = asked.join(group.select("mention").distinct(), "mention", "left_anti")
    return _rows(matches, "resolved", "value").unionByName(_rows(asked_back, "ambiguous", "value")).unionByName(_rows(missing, "not_found", "value"))


def resolve_mentions(mentions: DataFrame, catalogue: DataFrame, references: DataFrame) -> DataFrame:
    """What each distinct mention (column mention) stands for among stored values.

    A resolved mention has a row for each table and column that holds it, with the stored spellings there; an ambiguous one
    has one row with up to LABELS candidates (a reference: all); one that isn't found has one row.  Columns: mention,
    status, kind (reference or value), table_name, column_name, values, match_kind, score, candidates.
    Null and blank mentions are left out.  ``catalogue`` is that of ``catalogue_of``, ``references`` that of ``references_of``.
    """
    asked = settled(mentions.select(F.trim("mention").alias("mention")).where("mention <> ''").distinct().select("mention", reference_key(F.col("mention")).alias("key"), without_noise(normalised(F.col("mention"))).alias("m")))
    shaped = is_reference(F.col("key"))
    by_reference = _by_reference(asked.where(shaped).drop("m"), references)
    return by_reference.unionByName(_by_value(asked.where(~shaped).drop("key"), catalogue)).select(*_OUT)


def mentions_of(questions: DataFrame) -> DataFrame:
    """The mentions of understood questions (question_id, entities, filters: arrays of string): question_id, place, mention.

    Entities come first, then what stands in quotes in the filters; a mention that repeats counts once, at its first place.
    """
    quoted = F.transform(F.coalesce("filters", F.array().cast("array<string>")), lambda f: F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(r"""'(.*?)'|"(.*?)\""""), F.lit(0)))
    inner = F.transform(F.flatten(quoted), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    every = F.filter(F.transform(F.concat(F.coalesce("entities", F.array().cast("array<string>")), inner), lambda m: F.trim(m)), lambda m: m.isNotNull() & (m != ""))
    return questions.select("question_id", F.posexplode(F.array_distinct(every)).alias("place", "mention"))


def resolve_questions(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Whether each question has to be asked back: question_id, needs_clarification, clarification_question.

    ``questions`` also has scope: only an ambiguous mention that occurs in it (in normal form; null: any) blocks; the first such mention is asked about.
    """
    found = mentions_of(questions).join(questions.select("question_id", normalised(F.col("scope")).alias("scope")), "question_id")
    unclear = resolved.where("status = 'ambiguous'").select("mention", "candidates")
    inside = F.col("scope").isNull() | F.contains(F.col("scope"), normalised(F.col("mention")))
    first = found.join(unclear, "mention").where(inside).groupBy("question_id").agg(F.min(F.struct("place", "mention", "candidates")).alias("m"))
    options = F.array_join(F.transform("m.candidates", lambda c: F.concat(F.lit('"'), c, F.lit('"'))), " or ")
    asked = first.select("question_id", F.concat(F.lit("Did you mean "), options, F.lit(' for "'), F.col("m.mention"), F.lit('"?')).alias("q"))
    return questions.select("question_id").join(asked, "question_id", "left").select("question_id", F.col("q").isNotNull().alias("needs_clarification"), F.coalesce("q", F.lit("")).alias("clarification_question"))


def stored_values(resolved: DataFrame) -> DataFrame:
    """What a planner is shown: only resolved mentions travel."""
    return resolved.where("status = 'resolved'").select("mention", "table_name", "column_name", "values", "match_kind")
