"""Line dedup by a log-template tree, as DataFrame operations only.

Every line walks a tree of fixed depth: first its number of tokens, then its
leading tokens with digits masked. What lies in one leaf is compared with the
leaf's most common masked line, its seed; lines that agree with it in enough
positions share its template, the other positions being variable fields. The
rest of the leaf goes through the same step again until no line is left. A
template seen in several different texts recurs; its lines are dropped from
all texts but the first.

Many seeds are found in one step: lines that agree have equal tokens in some
part of the line, so a line that is the most common open one among all that
share a part with it agrees with no more common open line, and is a seed.

Only leaves reached by two texts can hold a recurring template, so the text of
a line is moved for those alone. Documents are joined with the numbers of
their dropped lines once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.llm.common import c, text_of
from tabsmith.session import materialise


def masked(line: Column) -> Column:
    """The line without outer blanks and with every run of digits as one mark."""
    bare = F.trim(line)
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[0-9]+", "0")).otherwise(bare)


def agreement(a: Column, b: Column) -> Column:
    """Share of the positions at which two lines of as many tokens agree, given their tokens."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def line_rows(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(doc, twin, n, line, tokens, leaf): one row per line that is not blank; `twin` names the whole text."""
    text = text_of(text_col)
    # The text ends here: behind the generator only its hash goes along with each line.
    held = docs.select(c(id_col).alias("doc"), F.xxhash64(text).alias("twin"), F.split(text, "\n").alias("lines"))
    rows = held.select("doc", "twin", F.posexplode("lines").alias("n", "raw"))
    rows = rows.withColumn("line", masked(F.col("raw"))).drop("raw")
    rows = rows.withColumn("tokens", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    rows = rows.filter("line != ''")
    return rows.withColumn("leaf", F.xxhash64("tokens", F.substring_index("line", " ", depth)))


def _parts(leaf: Column, words: Column, depth: int, likeness: float) -> Column:
    """Hashes of a line's parts; two lines of a leaf that agree share one.

    With at most m differing tokens, one of m + 1 blocks of tokens is equal and
    two of m + 2 are. Few blocks are taken by twos, for two say more.
    """
    size = F.size(words)
    most = F.floor(size * (1 - likeness) + 1e-9).cast("int")
    free = F.greatest(size - depth, F.lit(0))
    by_two = most <= 3
    n = most + F.when(by_two, 2).otherwise(1)
    low = lambda b: F.floor(b * free / n).cast("int")
    block = lambda b: F.slice(words, depth + 1 + low(b), low(b + 1) - low(b))
    twos = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(
        F.sequence(i + 1, n - 1), lambda j: F.xxhash64(leaf, i, j, block(i), block(j)))))
    ones = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(leaf, i, block(i)))
    return F.when(by_two, twos).otherwise(ones)


def _named(kinds: DataFrame, depth: int, likeness: float) -> DataFrame:
    """(leaf, kind, tokens, template): every masked line with its seed, which is itself where it agrees with none.

    The rule is that of one seed after another: the most common open line of a
    leaf takes the open lines that agree with it, till none is open. The first
    two seeds end most leaves; lines that they leave open are cut into parts.
    """
    left = kinds.withColumn("template", F.lit(None).cast("long"))
    for _ in range(2):
        # Each leaf has one seed here, so the join adds no rows.
        seeds = left.filter("template is null").groupBy("leaf").agg(
            F.max(F.struct("texts", "line", "kind")).alias("seed")
        )
        alike = agreement(F.split("line", " "), F.split("seed.line", " ")) >= likeness
        left = left.join(seeds, "leaf", "left").withColumn(
            "template", F.when(F.col("template").isNull() & alike, F.col("seed.kind")).otherwise(F.col("template"))
        ).drop("seed")
    still = F.when(F.col("template").isNull(), F.col("line")).alias("line")
    left = materialise(left.select("leaf", "kind", "tokens", "texts", "template", still), "template-left")
    rest = _rest(left.filter("template is null"), depth, likeness)
    own = left.select("leaf", "kind", "tokens", "template")
    if rest is not None:
        own = own.join(rest, ["leaf", "kind"], "left").withColumn("template", F.coalesce("template", "later")).drop("later")
    return own.withColumn("template", F.coalesce("template", "kind"))


def _rest(kinds: DataFrame, depth: int, likeness: float) -> DataFrame | None:
    """(leaf, kind, later): the seeds of those of the given masked lines that agree with a more common one."""
    several = kinds.groupBy("leaf").agg(F.count("*").alias("k")).filter("k > 1").select("leaf")
    nodes = kinds.join(several, "leaf", "left_semi").orderBy(F.desc("texts"), F.desc("line"), F.desc("kind"))
    # Lines are numbered by rank: a smaller node is the more common line.
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "leaf", "kind", F.split("line", " ").alias("words"))
    nodes = materialise(nodes, "template-nodes")
    parts = F.explode(F.array_distinct(_parts(F.col("leaf"), F.col("words"), depth, likeness))).alias("part")
    entries = materialise(nodes.select("node", parts), "template-parts")
    met = entries.groupBy("part").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("part")
    # `seed` is the best seed so far; the line is open without one.
    entries = entries.join(met, "part", "left_semi").withColumn("seed", F.lit(None).cast("long"))
    entries = materialise(entries, "template-entries")
    words = nodes.select("node", "words")
    found = None
    while entries.filter("seed is null").limit(1).count():
        tops = entries.filter("seed is null").groupBy("part").agg(F.min("node").alias("top"))
        # Parts without an open line are done.
        placed = materialise(entries.join(tops, "part"), "template-placed")
        seeds = placed.filter("seed is null").groupBy("node").agg(F.min("top").alias("top")).filter("top = node").select("top")
        # A later seed may be more common than the one that a line has.
        near = placed.filter("node > top and (seed is null or seed > top)").select("node", "top").distinct()
        near = near.join(seeds, "top").join(words, "node").join(
            words.select(F.col("node").alias("top"), F.col("words").alias("_words")), "top"
        )
        near = near.filter(agreement(F.col("words"), F.col("_words")) >= likeness).select("node", "top")
        now = near.union(seeds.select(F.col("top").alias("node"), "top")).groupBy("node").agg(F.min("top").alias("top"))
        now = materialise(now, "template-seeds")
        found = now if found is None else found.union(now)
        entries = placed.drop("top").join(now, "node", "left").select("part", "node", F.least("seed", "top").alias("seed"))
        entries = materialise(entries, "template-entries")
    if found is None:
        return None
    best = found.groupBy("node").agg(F.min("top").alias("top")).filter("top < node")
    return best.join(nodes.select("node", "leaf", "kind"), "node").join(
        nodes.select(F.col("node").alias("top"), F.col("kind").alias("later")), "top"
    ).select("leaf", "kind", "later")


def recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    likeness: float = 0.75,
    min_texts: int = 2,
    min_tokens: int = 5,
    min_chars: int = 40,
    short_texts: int = 10,
) -> DataFrame:
    """(doc, twin, n, template, texts, first): the lines whose template recurs.

    `texts` counts the different whole texts that hold the template, `first`
    says that the line belongs to the smallest (id, text hash) of them. Exact
    copies of a document count as one text. Templates of fewer than
    `min_tokens` tokens recur by chance and need `short_texts` texts, unless a
    masked line of theirs has `min_chars` characters: a line without blanks
    may be long. Only blank lines never count.
    """
    rows = line_rows(docs, id_col, text_col, depth)
    seen = rows.groupBy("leaf").agg(F.min("twin").alias("_a"), F.max("twin").alias("_b")).filter("_a != _b").select("leaf")
    lines = rows.join(seen, "leaf", "left_semi").withColumn("kind", F.xxhash64("line"))
    lines = materialise(lines, "template-lines")
    # One row per masked line: how many texts hold it, and the line itself.
    held = lines.groupBy("leaf", "kind", "twin").agg(F.first("line").alias("line"), F.first("tokens").alias("tokens"))
    kinds = held.groupBy("leaf", "kind").agg(
        F.count("*").alias("texts"), F.first("line").alias("line"), F.first("tokens").alias("tokens")
    )
    named = materialise(_named(materialise(kinds, "template-kinds"), depth, likeness), "template-names")
    lines = lines.withColumn("chars", F.length("line")).drop("line", "tokens").join(named, ["leaf", "kind"])
    spots = lines.groupBy("leaf", "template", "twin").agg(
        F.min("doc").alias("doc"), F.first("tokens").alias("tokens"), F.max("chars").alias("chars")
    )
    found = spots.groupBy("leaf", "template").agg(
        F.count("*").alias("texts"),
        F.min(F.struct(F.col("doc").isNull(), "doc", "twin"))["twin"].alias("_first"),
        F.first("tokens").alias("tokens"),
        F.max("chars").alias("chars"),
    )
    long = (F.col("tokens") >= min_tokens) | (F.col("chars") >= min_chars)
    found = found.filter(F.col("texts") >= F.when(long, F.lit(min_texts)).otherwise(F.lit(short_texts))).drop("tokens", "chars")
    return lines.join(found, ["leaf", "template"]).select(
        "doc", "twin", "n", "template", "texts", (F.col("twin") == F.col("_first")).alias("first")
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] | None = None,
    **options,
) -> DataFrame:
    """The documents with their recurring lines removed.

    All columns of `docs` stay, `text_col` without the dropped lines. `counts`
    names two more columns for the number of lines and of dropped lines. The first
    text that holds a template keeps it, and its exact copies with it, so no
    line leaves the corpus. A null text stays null with 0 lines, an empty text
    has one empty line; both lose nothing. Repeated rows get the same
    decision. A null id is an id like any other. An empty table gives no rows.
    """
    names = docs.columns
    gone = recurring_lines(docs, id_col, text_col, **options).filter(~F.col("first"))
    gone = gone.groupBy("doc", "twin").agg(F.collect_set("n").alias("_gone"))
    # Texts travel as their lines: a line is then looked up in a plain column, once.
    held = docs.select(
        F.struct(F.lit(0).alias("_"), *[c(x) for x in names if x != text_col]).alias("_row"),
        F.split(c(text_col).cast("string"), "\n").alias("_lines"),
        c(id_col).alias("_doc"),
        F.xxhash64(text_of(text_col)).alias("_twin"),
    )
    both = held.join(gone, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_twin") == F.col("twin")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    numbers = []
    if counts:
        if set(counts) & set(names):
            raise ValueError(f"the documents have a column of the name {counts} already")
        numbers = [
            F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias(counts[0]),
            F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias(counts[1]),
        ]
    return both.select(
        *[kept.alias(x) if x == text_col else F.col("_row").getField(x).alias(x) for x in names], *numbers
    )
