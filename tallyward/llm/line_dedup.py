"""Fuzzy line deduplication by SimHash blocks, word runs and edit similarity.

Lines are compared by their words: lower case, without ASCII blanks and signs.
Each line gets two 64-bit hashes of its words, by which equal lines are merged,
and a 64-bit SimHash. Fingerprints at most ``radius`` bits apart agree on
all but ``radius`` of their blocks (pigeonhole), so the blocks agreed on are a
join key; there are as many blocks as make keys longer than the number of lines
calls for, which keeps unrelated lines apart at any size.

Lines of similarity 0.8 are often further apart than any radius such keys can
cover, so the same principle is applied to the words: edits leave runs between
them whole. A short line's keys are itself and the line without each of its words,
which lines one word apart share; a longer line's are the least hashes of its runs of
four words. Pairs that meet there go on if their fingerprints differ in at most
``FAR`` bits.

Pairs are verified by their edit similarity in words, linked lines form groups, and
of each group the occurrence in the smallest document, at its first place, is kept.

All of it is Spark expressions. A frequent line is one row from the first
aggregation on, and its many occurrences meet one row of its group in a join
whose large side Spark splits. Of a large key's lines each is first compared with the
most frequent one, by words also with the most frequent of its own length. Those still
in different components then meet within ``radius`` bits, or by their rarest words: of
two lines of similarity J the rarest word they share is among the rarest ``1 - J`` of
each, and one more. So neither copies nor lines around a common phrase pair up, and no
partner of a large key is left out.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.components import connected_components
from tallyward.llm.shared import settled

BITS = 64
# Fingerprints of lines with a fifth of their words changed differ in about 13 bits
# (sd 3), those of unrelated lines in about 32.
FAR = 26
# Lines of fewer words are similar only if they are equal; up to SHORT words, similar
# lines are one word apart at the most.
LEAST_WORDS, SHORT = 4, 9
RUN_WORDS, RUNS, FEW = 4, 3, 16
_LAST = 2**63 - 1
_SIEVE = 1 << 20


def line_words(line: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(line), "[\\x00-/:-`{-\\x7F]+"), "")


def _majority(hashes: Column, width: int) -> Column:
    """The bits that more than half of fewer than ``2 ** (width - 1)`` hashes set.

    Counts of ``64 / width`` bits lie side by side in one number. Adding what
    half of the hashes fall short of the lane's last bit but one sets that bit in
    the lanes of the majority.
    """
    lanes = F.lit(sum(1 << at for at in range(0, BITS, width)))
    short = F.lit((1 << (width - 2)) - 1) - F.floor(F.size(hashes) / 2)

    def over_half(bit: int) -> Column:
        counts = F.aggregate(
            hashes,
            F.lit(0).cast("long"),
            lambda total, h: total + F.shiftrightunsigned(h, bit).bitwiseAND(lanes),
        )
        marks = F.shiftrightunsigned(counts + short * lanes, width - 2)
        return F.shiftleft(marks.bitwiseAND(lanes), bit)

    return reduce(Column.bitwiseOR, map(over_half, range(width)))


def line_print(hashes: Column) -> Column:
    """A bit is 1 if more than half of the distinct words' hashes set it: repeated
    frequent words would make unlike lines alike. Short lines count in narrow
    lanes, which is only quicker."""
    n = F.size(hashes)
    return (
        F.when(n < 1 << 7, _majority(hashes, 8))
        .when(n < 1 << 15, _majority(hashes, 16))
        .otherwise(_majority(hashes, 32))
    )


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, text_key, at, line`` of every line.

    ``doc`` orders documents: null ids come last.
    """
    return docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("at", "line"),
    )


def _word_hashes(lines: DataFrame) -> DataFrame:
    words = lines.select("doc", "text_key", "at", line_words(F.col("line")).alias("words"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    return words.select("doc", "text_key", "at", hashes.alias("hashes"))


def run_keys(hashes: Column, twos: Column) -> Column:
    """Keys by which similar lines meet, from the hashes of a line's words, and of two
    words in a row."""
    n = F.size(hashes)
    without = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.xxhash64(
            F.lit(1), F.concat(F.slice(hashes, F.lit(1), i - 1), F.slice(hashes, i + 1, n))
        ),
    )
    without = F.concat(F.array(F.xxhash64(F.lit(1), hashes)), without)
    # Two pairs of words in a row are a run of RUN_WORDS words.
    fours = F.zip_with(twos, F.slice(twos, F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    runs = F.sort_array(F.slice(fours, F.lit(1), n - (RUN_WORDS - 1)))
    least = F.slice(runs, 1, RUNS)
    none = F.array().cast("array<long>")
    # A line of one word less or more than SHORT can be up to two words apart.
    return F.concat(
        F.when(n.between(LEAST_WORDS, SHORT), F.array_distinct(without)).otherwise(none),
        F.when(n >= SHORT - 1, F.array_distinct(least)).otherwise(none),
    )


def line_prints(docs: DataFrame) -> DataFrame:
    """``doc, text_key, at, n_words, k1, k2, fp, keys`` of every line."""
    after = F.slice("hashes", F.lit(2), F.size("hashes"))
    # What is used several times is a column: lambdas are not shared within one.
    hashed = _word_hashes(_lines(docs)).select(
        "*",
        F.array_distinct("hashes").alias("distinct"),
        F.zip_with("hashes", after, lambda a, b: F.xxhash64(a, b)).alias("twos"),
    )
    return hashed.select(
        "doc",
        "text_key",
        "at",
        F.size("hashes").alias("n_words"),
        F.xxhash64("hashes").alias("k1"),
        F.xxhash64(F.lit(7), "hashes").alias("k2"),
        line_print(F.col("distinct")).alias("fp"),
        run_keys(F.col("hashes"), F.col("twos")).alias("keys"),
    )


def block_masks(n: int, radius: int = 3) -> list[int]:
    """Masks of the kept blocks of every key, as signed numbers, for ``n`` lines.

    Keys have at least two bits more than numbering the lines takes.
    """
    need = min(math.log2(max(n, 2)) + 2, BITS - 1)
    blocks = radius + 1
    while BITS // blocks * (blocks - radius) < need and blocks < BITS:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in kept)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _near_prints(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``fp_a, fp_b`` of fingerprints within ``radius`` that share a key with few
    others, and ``key, fp`` of the keys that more than ``FEW`` share.

    A key is a hash of the kept blocks and which they are. Most that meet by
    chance meet in twos or threes, which the least, the greatest and the exclusive or
    of a key's fingerprints tell apart at once; only larger keys are looked up again.
    """
    masks = block_masks(prints.count(), radius)
    key = F.xxhash64("key_no", F.col("fp").bitwiseAND(F.col("mask")))
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("key_no", "mask")
    ).select(key.alias("key"), "fp")
    met = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("sharers"),
        F.min("fp").alias("low"),
        F.max("fp").alias("high"),
        F.bit_xor("fp").alias("all"),
    )
    third = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    met = met.where("sharers > 1").withColumn(
        "third", F.when(F.col("sharers") == 3, third).otherwise(F.col("high"))
    )
    near = _within(radius, "low", "high")
    near = near | _within(radius, "low", "third") | (
        (F.col("sharers") == 3) & _within(radius, "third", "high")
    )
    met = settled(met.where((F.col("sharers") > 3) | near).drop("all"), "met")

    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("fp_a"), F.col(b).alias("fp_b"))

    of_three = F.array(pair("low", "high"), pair("low", "third"), pair("third", "high"))
    pairs = met.where("sharers <= 3").select(F.inline(of_three))
    large = met.where("sharers > 3").select("key", "sharers")
    crowd = settled(_sifted(keyed, large, "key").join(large, "key"), "crowd")
    few = crowd.where(F.col("sharers") <= FEW).select("key", F.col("fp").alias("fp_a"))
    few = few.join(few.withColumnRenamed("fp_a", "fp_b"), "key")
    pairs = pairs.unionAll(few.where(F.col("fp_a") < F.col("fp_b")).where(_within(radius, "fp_a", "fp_b")).select("fp_a", "fp_b"))
    pairs = pairs.where("fp_a != fp_b").where(_within(radius, "fp_a", "fp_b"))
    pairs = pairs.select(
        F.least("fp_a", "fp_b").alias("fp_a"), F.greatest("fp_a", "fp_b").alias("fp_b")
    )
    return pairs.distinct(), crowd.where(F.col("sharers") > FEW).select("key", "fp")


def _by_prints(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of lines with fingerprints within ``radius``, and ``key, node, fp,
    n_words, n`` of the lines of keys that are too large to pair up."""
    prints = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("lines"))
    prints = settled(prints, "prints")
    pairs, crowd = _near_prints(prints.select("fp"), radius)
    several = prints.where("lines > 1")
    own = several.select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"))
    for side in ("a", "b"):
        lines = several.select(
            F.col("fp").alias(f"fp_{side}"), F.col("lines").alias(f"lines_{side}")
        )
        pairs = pairs.unionAll(own) if side == "a" else pairs
        pairs = pairs.join(lines, f"fp_{side}", "left")
    many = F.coalesce(F.greatest("lines_a", "lines_b"), F.lit(1)) > FEW
    pairs = settled(pairs.select("fp_a", "fp_b", many.alias("many")), "near")
    packed = F.explode(F.array_distinct(F.array("fp_a", "fp_b"))).alias("fp")
    crowd = crowd.unionAll(
        pairs.where("many").select(F.xxhash64("fp_a", "fp_b").alias("key"), packed)
    )
    ends = pairs.select(packed).unionAll(crowd.select("fp")).distinct()
    held = settled(nodes.select("node", "fp", "n_words", "n").join(ends, "fp"), "held")
    pairs = pairs.where("NOT many")
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("fp").alias(f"fp_{side}"), F.col("node").alias(side)), f"fp_{side}")
    return pairs.where("a != b").select("a", "b"), settled(crowd.join(held, "fp"), "blocks")


def _within(radius: int, a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _apart(a: str, b: str, similarity: float) -> Column:
    """Whether two numbers of words alone tell that lines are not similar enough."""
    most = F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9)
    return F.abs(F.col(a) - F.col(b)) > most


def _sifted(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``columns`` are among those of ``wanted``, and few others: a table
    of at most a million hash values is sent to all tasks, so that what is not in it is
    not moved for the join that decides."""

    def slot() -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(_SIEVE))

    sieve = wanted.select(slot().alias("_slot")).distinct()
    return rows.join(F.broadcast(sieve), slot() == F.col("_slot"), "left_semi")


def _coded(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, coded``: each node's line at its first place, a character for a word.

    A word is one of a million characters beyond the basic plane, by its hash.
    """
    place = ["doc", "text_key", "at"]
    near = _sifted(_lines(docs), nodes, *place)
    found = near.join(nodes.select("node", *place), place)
    # Repeated rows: the join has sorted by place already.
    found = found.groupBy(*place).agg(F.first("node").alias("node"), F.first("line").alias("line"))
    hashes = F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w))
    points = F.transform(
        hashes, lambda h: F.lpad(F.hex(F.pmod(h, F.lit(1_000_000)) + 0x10000), 8, "0")
    )
    return found.select(
        "node", F.decode(F.unhex(F.array_join(points, "")), "UTF-32").alias("coded")
    )


def _verified(pairs: DataFrame, coded: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose lines are similar enough: words to insert, delete
    or replace over the words of the longer line are at most ``1 - similarity``."""
    left = coded.select(F.col("node").alias("a"), F.col("coded").alias("coded_a"))
    right = coded.select(F.col("node").alias("b"), F.col("coded").alias("coded_b"))
    longest = F.greatest(F.length("coded_a"), F.length("coded_b"))
    most = F.floor(longest * (1 - similarity) + 1e-9).cast("int")
    # Most pairs differ in a few words, which a narrow band finds out.
    few = F.expr("levenshtein(coded_a, coded_b, least(most, 8))")
    many = F.expr("levenshtein(coded_a, coded_b, most)")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("most", most)
        .where(F.abs(F.length("coded_a") - F.length("coded_b")) <= F.col("most"))
        .where((few >= 0) | (many >= 0))
        .select("a", "b")
    )


def _run_sharers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of the lines of run keys that two share, ``key, node, sharers`` of
    larger keys."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition("key")
    met = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("sharers"), F.max("node").alias("a"), F.min("node").alias("b")
    )
    met = settled(met.where("sharers > 1"), "met")
    larger = keyed.join(met.where("sharers > 2").select("key", "sharers"), "key")
    return met.where("sharers = 2").select("a", "b"), settled(larger, "runs")


def _by_runs(
    nodes: DataFrame, similarity: float, shared: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """``a, b`` of lines that share a run key (``_run_sharers``): every pair of a key
    with at most ``FEW`` lines, so that none meets more than that, and in larger keys
    each line against the most frequent one and the most frequent one of its own
    length. The rest of these meet in ``_by_rare_words``."""
    columns = ["node", "fp", "n_words", "n"]
    pairs, crowd = _run_sharers(nodes) if shared is None else shared
    known = nodes.select(*columns)
    pairs = pairs.distinct()
    few = crowd.where(F.col("sharers") <= FEW).select("key", "node")
    other = few.select("key", F.col("node").alias("b"))
    few = few.join(other, "key").where("node > b").select(F.col("node").alias("a"), "b")
    pairs = pairs.unionAll(few.distinct())
    more = crowd.where(F.col("sharers") > FEW).drop("sharers").join(known, "node")
    for group in (["key"], ["key", "n_words"]):
        lead = F.max(F.struct("n", (-F.col("node")).alias("rank"))).alias("lead")
        leads = more.groupBy(*group).agg(lead).withColumn("b", -F.col("lead.rank")).drop("lead")
        star = more.join(leads, group).where("node != b").select(F.col("node").alias("a"), "b")
        pairs = pairs.unionAll(star)
    for side in ("a", "b"):
        own = known.select(*[F.col(c).alias(c if c == "node" else f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, F.col(side) == F.col("node")).drop("node")
    pairs = pairs.where(_within(FAR, "fp_a", "fp_b"))
    return pairs.where(~_apart("n_words_a", "n_words_b", similarity)).select("a", "b")


def _mixed(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``placed`` with their ``root`` whose key has several components."""
    rooted = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    return settled(rooted.join(mixed.where("least != most").select("key"), "key"), "mixed")


def _by_rare_words(mixed: DataFrame, coded: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of lines of different components that share a key of ``mixed`` (``key,
    node, root``) and one of their rarest words.

    Words are ranked by how many of these lines have them, then by value. Of similar
    lines at most ``1 - similarity`` of each one's words are not in the other, so the
    first word they share is among that many of both, and one more. Each pair comes
    once, by the first key and the first word that both have.
    """
    lines = coded.join(mixed.select("node").distinct(), "node").select(
        "node",
        F.length("coded").alias("n_words"),
        F.explode(F.array_distinct(F.split("coded", ""))).alias("word"),
    )
    # There are a million words at most, so all tasks can have the counts, and the lines
    # stay where they are.
    lines = lines.withColumn("word", F.ascii("word"))
    counts = lines.groupBy("word").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    counted = lines.join(F.broadcast(counts), "word", "left")
    own = F.struct(F.coalesce("lines", F.lit(1)).alias("lines"), "word")
    ranked = counted.groupBy("node", "n_words").agg(
        F.array_sort(F.collect_list(own)).alias("ranked")
    )
    most = F.floor(F.col("n_words") * (1 - similarity) + 1e-9).cast("int")
    rare = F.filter(F.slice("ranked", F.lit(1), most + 1), lambda own: own["lines"] > 1)
    # Written: both sides of the join would rank the lines.
    ranked = settled(ranked.select("node", "n_words", rare["word"].alias("rare")), "ranked")
    held = mixed.groupBy("node", "root").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    held = held.join(ranked, "node")

    def placed(name: str, array: str) -> DataFrame:
        """``held`` for each entry of an array, with those before it."""
        each = held.select("*", F.posexplode(array).alias("_at", name))
        before = F.slice(array, F.lit(1), F.col("_at")).alias(f"before_{name}")
        return each.select("*", before).drop("_at", array)

    held = placed("key", "keys")
    held = placed("word", "rare")
    # Both sides are the same rows, which are shuffled once. Lines that share several
    # keys or words meet by the first of each only.
    one, two = held.alias("one"), held.alias("two")
    pairs = one.join(two, [F.col(f"one.{c}") == F.col(f"two.{c}") for c in ("key", "word")])
    pairs = pairs.where("one.root < two.root").where(~_apart("one.n_words", "two.n_words", similarity))
    for before in ("before_key", "before_word"):
        pairs = pairs.where(~F.arrays_overlap(f"one.{before}", f"two.{before}"))
    return pairs.select(
        F.greatest("one.node", "two.node").alias("a"), F.least("one.node", "two.node").alias("b")
    )


def _by_distance(mixed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``a, b`` of lines of different components that share a key of ``mixed`` and have
    fingerprints within ``radius``."""
    other = mixed.select(
        "key",
        F.col("node").alias("other"),
        F.col("fp").alias("fp_b"),
        F.col("root").alias("root_b"),
        F.col("n_words").alias("n_b"),
    )
    pairs = mixed.join(other, "key").where("root < root_b")
    pairs = pairs.where(~_apart("n_words", "n_b", similarity)).where(_within(radius, "fp", "fp_b"))
    return pairs.select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")
    )


def line_groups(
    docs: DataFrame, lines: DataFrame, radius: int = 3, similarity: float = 0.8
) -> DataFrame:
    """``k1, k2, root, first_doc`` of every line of ``lines`` (``line_prints``)
    that occurs more than once or is linked to another: its group and the
    smallest document that has the group.
    """
    nodes = lines.groupBy("k1", "k2").agg(
        F.min("fp").alias("fp"),
        F.min(F.struct("doc", "text_key", "at")).alias("first"),
        F.min("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("n"),
        F.first("keys").alias("keys"),
    )
    nodes = nodes.select("k1", "k2", "fp", "n_words", "n", "first.*", "keys")
    nodes = settled(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linkable = nodes.where(F.col("n_words") >= LEAST_WORDS)
    nodes = nodes.drop("keys")
    near, placed = _by_prints(linkable, radius)
    shared = _run_sharers(linkable)

    # Each line of a large key against the key's most frequent one.
    lead = F.max(F.struct("n", (-F.col("node")).alias("rank"), "fp", "n_words"))
    leads = placed.groupBy("key").agg(lead.alias("lead")).select(
        "key",
        (-F.col("lead.rank")).alias("b"),
        F.col("lead.fp").alias("fp_b"),
        F.col("lead.n_words").alias("n_b"),
    )
    star = placed.withColumnRenamed("node", "a").join(leads, "key").where("a != b")
    star = star.where(_within(radius, "fp", "fp_b")).where(~_apart("n_words", "n_b", similarity))
    tried = star.select("a", "b").unionAll(near).unionAll(_by_runs(linkable, similarity, shared))
    tried = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tried = settled(tried.distinct(), "pairs")
    crowd = shared[1].where(F.col("sharers") > FEW).select("key", "node")
    ends = tried.select(F.explode(F.array("a", "b")).alias("node"))
    ends = ends.unionAll(crowd.select("node")).unionAll(placed.select("node")).distinct()
    coded = settled(_coded(docs, nodes.join(ends, "node")), "coded")
    links = settled(_verified(tried, coded, similarity), "links")
    roots = connected_components(links)

    # Lines of large keys in different components that were not compared yet.
    more = _by_rare_words(_mixed(crowd, roots), coded, similarity)
    if not placed.isEmpty():
        more = more.unionAll(_by_distance(_mixed(placed, roots), radius, similarity))
    more = settled(more.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = settled(_verified(more, coded, similarity), "links")
        if not found.isEmpty():
            # Components are links enough: each line with its root.
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = connected_components(known.unionAll(found))

    grouped = nodes.join(roots, "node", "left")
    marked = grouped.where("n > 1 OR root IS NOT NULL").withColumn(
        "root", F.coalesce("root", "node")
    )
    firsts = marked.groupBy("root").agg(F.min("doc").alias("first_doc"))
    return marked.join(firsts, "root").select("k1", "k2", "root", "first_doc")


def dedup_lines(docs: DataFrame, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """``docs`` with repeated and near-equal lines taken out of ``text``, and
    ``removed_lines``, their number.

    Of each group the first line in the document with the smallest id stays;
    null ids count as the largest. Lines without a word stay. Null
    and empty texts stay as they are. Rows with equal id and text are one
    document and keep the same lines. All columns stay; an empty table gives an
    empty one.
    """
    texts = docs.select("doc_id", "text")
    lines = settled(line_prints(texts), "lines").where("n_words > 0")
    groups = settled(line_groups(texts, lines, radius, similarity), "groups")
    held = lines.join(groups, ["k1", "k2"]).select("doc", "text_key", "at", "root", "first_doc")
    own = Window.partitionBy("doc", "text_key", "root")
    again = (
        held.where("doc = first_doc")
        .withColumn("first_at", F.min("at").over(own))
        .where("at > first_at")
        .select("doc", "text_key", "at")
    )
    gone = held.where("doc > first_doc").select("doc", "text_key", "at").unionAll(again)
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set("at").alias("_gone"))
    gone = gone.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), "_gone")
    kept = F.filter(
        F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i)
    )
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return (
        docs.join(
            gone,
            (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_doc"))
            & (F.xxhash64("text") == F.col("_key")),
            "left",
        )
        .withColumn("text", text)
        .withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .drop("_gone", "_doc", "_key")
    )
