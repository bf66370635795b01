"""Training sets by drawing elements first and scoring only what was drawn.

A training set keeps the touched elements of a question and as many others, so scoring all elements for all questions
is nearly all wasted. Here the touched elements are looked up, the others are drawn by digest from blocks of the
element list, and only these pairs meet vectors: a question goes to the tables of its elements, whose documents pass
it there. Indexes with more documents than a question keeps of them are searched before for the last kept hit, as
only documents up to it count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators import training
from slink.operators.block_stream import cell_stream
from slink.operators.element_scores import DRAWN_SCHEMA, ORDER, SCORE_SCHEMA, all_scores, first_known, numbered_documents, wanted_scores
from slink.operators.grouping import number_rows, top_k_per_group
from slink.operators.ranking import ELEMENT, LEVELS, WIDE_CELLS, element_stream, feature_vectors, level, with_cuts
from slink.operators.search import DOCUMENT_BLOCK, HELD_NUMBERS, LEAST_QUESTIONS, SOURCE, shown_score, source_of
from slink.sources.stores import materialize

ELEMENT_BLOCK = 4096
# Documents of a table that pass its questions in one task.
TABLE_DOCUMENTS = 65_536
KEY = ["question_id", *ELEMENT]


def _same_element(left: DataFrame, right: DataFrame) -> Column:
    return (
        (left[SOURCE] == right[SOURCE])
        & (left["table_id"] == right["table_id"])
        & left["column_id"].eqNullSafe(right["column_id"])
        & left["value"].eqNullSafe(right["value"])
    )


class Sampler:
    """Elements, their documents and the questions of a training set, and what of them was searched.

    `questions` has question_id, embedding and maybe a data source, `documents` is the index.
    """

    def __init__(self, questions: DataFrame, documents: DataFrame, limits: tuple[int, int] = fixed.TRAINING_RANK_LIMITS):
        self.documents = documents.select(source_of(documents), "index_name", "vec_id", *ELEMENT, "embedding")
        asked, self.over = with_cuts(questions, self.documents, limits)
        self.searched = bool(self.over)
        self.questions = materialize(asked, "asked") if self.searched else asked
        # An element is sure to have a score if it is in an index that is kept whole.
        cut = F.col("index_name").isin([fixed.ALL_INDEXES[i] for i in self.over])
        sure = F.max(~F.coalesce(cut, F.lit(False))).alias("sure")
        self.all_elements = materialize(self.documents.groupBy(SOURCE, *ELEMENT).agg(sure), "elements")
        self.elements = self.all_elements.filter("sure").drop("sure")
        in_doubt = self.all_elements.filter(~F.col("sure"))
        self.doubtful = self.documents.join(in_doubt, _same_element(self.documents, in_doubt), "left_semi") if self.searched else None

    @property
    def hits(self) -> DataFrame | None:
        """Of the kept hits in indexes that were searched the lowest score per question, index and element."""
        if not self.searched:
            return None
        names = [fixed.ALL_INDEXES[i] for i in self.over]
        there = self.documents.filter(F.col("index_name").isin(names))
        wide = element_stream(self.questions, there, all_scores(self.over, WIDE_CELLS), SCORE_SCHEMA)
        scores = F.explode(F.array(*[F.struct(F.lit(n).alias("index_name"), F.col(f"{n}_score").alias("score")) for n in names]))
        return wide.select(*KEY, scores.alias("hit")).select(*KEY, "hit.*").filter(F.col("score").isNotNull())

    def value_candidates(self, touches: DataFrame) -> DataFrame:
        """Value elements that a touched value means: those equal to it but for case."""
        wanted = touches.filter(F.col("value").isNotNull()).select(
            "question_id", "table_id", "column_id", F.lower("value").alias("_lower")
        )
        asked = wanted.distinct().join(self.questions.select("question_id", SOURCE), "question_id")
        values = self.all_elements.filter(F.col("value").isNotNull()).withColumn("_lower", F.lower("value"))
        return asked.join(values, [SOURCE, "table_id", "column_id", "_lower"]).select(*KEY)

    def score(self, pairs: DataFrame) -> DataFrame:
        """The nine scores of those (question, element) pairs that have one, table scores copied onto columns.

        A question goes once to each table that it has elements of, and the table's documents pass there, so what is
        moved grows with the pairs and with the documents, not with the documents of each pair. Large tables are cut
        into slots by element, each with the table's own documents, and many questions of a slot into strips.
        """
        documents = numbered_documents(self.documents)
        slots = documents.groupBy(SOURCE, "table_id").agg(F.ceil(F.count("*") / TABLE_DOCUMENTS).cast("int").alias("slots"))
        slots = materialize(slots, "table-sizes")
        slot = F.pmod(F.xxhash64(F.col("column_id").cast("long"), "value"), F.col("slots")).cast("int")
        element = F.struct(F.col("column_id").cast("long").alias("column_id"), "value")
        sources = self.questions.select("question_id", SOURCE).distinct()
        placed = pairs.select(*KEY).distinct().join(sources, "question_id").join(slots, [SOURCE, "table_id"])
        wanted = placed.groupBy("question_id", SOURCE, "table_id", slot.alias("slot")).agg(F.collect_list(element).alias("wanted"))
        wanted = materialize(wanted, "wanted-elements")

        width, cores = self.documents.agg(F.max(F.size("embedding"))).first()[0], pairs.sparkSession.sparkContext.defaultParallelism
        most = min(HELD_NUMBERS // max(1, width or 1), max(LEAST_QUESTIONS, -(-wanted.count() // (2 * cores))))
        strips = F.ceil(F.count("*") / most).cast("int").alias("strips")
        cells = wanted.groupBy(SOURCE, "table_id", "slot").agg(strips).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
        place = [F.col(c) for c in (SOURCE, "table_id", "slot", "strip")]
        cells = materialize(number_rows(cells, [], F.pmod(F.xxhash64(*place), F.lit(ELEMENT_BLOCK)), place, "cell"), "cells")

        strip = F.pmod(F.xxhash64("question_id"), F.col("strips")).cast("int")
        counted = cells.filter("strip = 0").select(SOURCE, "table_id", "slot", "strips")
        left = wanted.join(counted, [SOURCE, "table_id", "slot"]).withColumn("strip", strip).drop("strips")
        left = left.join(cells.drop("strips"), [SOURCE, "table_id", "slot", "strip"]).select("cell", "question_id", SOURCE, "wanted")
        left = left.join(self.questions, ["question_id", SOURCE])
        everywhere = F.when(level() == "table", F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array(slot))
        right = documents.join(slots, [SOURCE, "table_id"]).withColumn("slot", F.explode(everywhere)).drop("slots")
        right = right.join(cells.select(SOURCE, "table_id", "slot", "cell"), [SOURCE, "table_id", "slot"]).drop("slot")
        found = cell_stream(left, right, max(1, cells.count()), wanted_scores(self.over), SCORE_SCHEMA, ORDER, DOCUMENT_BLOCK)
        types = {c: F.col(c).cast(pairs.schema[c].dataType) for c in KEY}
        return found.withColumns({**types, **{n: shown_score(n) for n in fixed.ALL_SCORES}})

    def positives(self, touches: DataFrame) -> DataFrame:
        """Touched elements with their scores: exact ones, and for values the best of those equal but for case."""
        plain = touches.filter(F.col("value").isNull()).select(*KEY)
        found = materialize(self.score(plain.union(self.value_candidates(touches))), "touched-scores")
        return found.filter(F.col("value").isNull()).unionByName(training.positives_ci(found, touches))

    def negative_pairs(self, touches: DataFrame, positive: DataFrame, seed: int = 0) -> DataFrame:
        """question, element and `wanted`: as many elements per question and level as were touched, none of them positive.

        Every block of the element list gives its first ones by the digest of (seed, question, element): as many as
        are wanted and as there are positives, so enough are left when these are taken out.
        """
        wanted = touches.select(*KEY).distinct().groupBy("question_id", level().alias("level")).agg(F.count("*").alias("wanted"))
        taken = positive.select(*KEY)
        held = taken.groupBy("question_id", level().alias("level")).agg(F.count("*").alias("held"))
        wanted = materialize(wanted.join(held, ["question_id", "level"], "left").fillna(0, ["held"]), "wanted")
        asked = wanted.join(self.questions.select("question_id", SOURCE), "question_id")
        n_blocks = -(-self.elements.count() // ELEMENT_BLOCK) or 1
        block = F.pmod(F.xxhash64(SOURCE, *ELEMENT), F.lit(n_blocks)).cast("int")
        blocks = (
            self.elements.withColumns({"block": block, "level": level()})
            .groupBy(SOURCE, "level", "block")
            .agg(F.collect_list(F.struct(*ELEMENT)).alias("elements"))  # about ELEMENT_BLOCK of them
        )
        met = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, [SOURCE, "level", "block"])

        def digest(e: Column) -> Column:
            parts = [F.lit(str(seed)), F.col("question_id").cast("string"), e["table_id"].cast("string")]
            rest = F.coalesce(e["column_id"].cast("string"), F.lit("")), F.coalesce(e["value"], F.lit(""))
            return F.md5(F.concat_ws("|", *parts, *rest))

        drawn = F.array_sort(F.transform("elements", lambda e: F.struct(digest(e).alias("digest"), e.alias("e"))))
        first = met.select("question_id", "level", "wanted", F.explode(F.slice(drawn, F.lit(1), (F.col("wanted") + F.col("held")).cast("int"))).alias("d"))
        pool = first.select("question_id", "level", "wanted", "d.digest", "d.e.*")
        if self.searched:
            also = self._first_known(wanted, seed)
            also = also.join(wanted.drop("held"), ["question_id", "level"])
            pool = pool.unionByName(also.select(*[F.col(c).cast(pool.schema[c].dataType).alias(c) for c in pool.columns]))
        left = pool.join(taken, training._null_safe(pool, taken), "left_anti")
        order = [F.col("digest"), *[F.col(c) for c in ELEMENT]]
        return top_k_per_group(left, ["question_id", "level"], order, F.col("wanted"), "_place", ELEMENT).select(*KEY, "level", "wanted")

    def _first_known(self, wanted: DataFrame, seed: int) -> DataFrame:
        """question, level, digest and element: of the elements in doubt that have a kept hit the first by digest, as many as are wanted and held."""
        n = [F.max(F.when(F.col("level") == name, F.col("wanted") + F.col("held"))) for name in LEVELS]
        draw = wanted.groupBy("question_id").agg(F.array(*[F.coalesce(x, F.lit(0)).cast("long") for x in n]).alias("draw"))
        found = element_stream(self.questions.join(draw, "question_id"), self.doubtful, first_known(self.over, WIDE_CELLS, seed), DRAWN_SCHEMA)
        # Documents in ranges have each their first ones, and a question may be there twice.
        return found.distinct()


def short_pools(pairs: DataFrame, touches: DataFrame) -> DataFrame:
    """Questions and levels for which fewer negatives were drawn than are wanted, none included."""
    keys = ["question_id", "level"]
    wanted = touches.select(*KEY).distinct().groupBy("question_id", level().alias("level")).agg(F.count("*").alias("wanted"))
    drawn = pairs.groupBy(*keys).agg(F.count("*").alias("sampled"))
    return wanted.join(drawn, keys, "left").fillna(0, ["sampled"]).filter("sampled < wanted")


def check_training(missing: DataFrame, short: DataFrame) -> None:
    """An error for a touched table or column without scores, and for a pool with fewer elements than are wanted."""
    lost = missing.filter(F.col("value").isNull()).limit(3).collect()
    if lost:
        raise ValueError(f"touched elements without scores, e.g. {[tuple(r) for r in lost]}")
    few = short.limit(3).collect()
    if few:
        raise ValueError(f"not enough elements to draw negatives from, e.g. {[tuple(r) for r in few]}")


def sampled_training_set(
    questions: DataFrame,
    documents: DataFrame,
    touches: DataFrame,
    groups: DataFrame,
    seed: int = 0,
    limits: tuple[int, int] = fixed.TRAINING_RANK_LIMITS,
    strict: bool = False,
) -> DataFrame:
    """The rows of `training.build_training_set`, of which only those that are kept are ever scored.

    With `strict` a touched table or column without scores is an error, and so is a question with fewer elements of
    a level than it needs negatives.
    """
    sampler = Sampler(questions, documents, limits)
    positive = materialize(sampler.positives(touches), "positives")
    pairs = materialize(sampler.negative_pairs(touches, positive, seed), "negatives")
    if strict:
        check_training(training.missing_positives(positive, touches), short_pools(pairs, touches))
    negative = sampler.score(pairs)
    return (
        training.stack_examples(positive, negative)
        .join(groups.select("question_id", "group_id"), "question_id")
        .select(
            *KEY,
            level().alias("element_type"),
            training.split_of(F.col("group_id")).alias("split"),
            feature_vectors().alias("features"),
            "label",
        )
    )
