"""Notes and the links between them: late-bound names, what comes up together, what resolves to nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stats import limited


def link_targets(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(key, note_id): titles, and names of exactly one note that no note is titled with."""
    own = titles.groupBy("key").agg(F.min("note_id").alias("note_id"))
    single = names.groupBy("key").agg(F.countDistinct("note_id").alias("n"), F.min("note_id").alias("note_id")).where("n = 1").select("key", "note_id")
    return own.union(single.join(titles.select("key"), "key", "left_anti"))


def resolve(links: DataFrame, targets: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """(entry_id, note_id), each once; links are bound when read, never stored."""
    found = links.join(targets.withColumnRenamed("key", "target"), "target").select("entry_id", "note_id")
    return (found if days is None else found.union(days.select("entry_id", "note_id"))).distinct()


def known_names(names: DataFrame, learned: DataFrame) -> DataFrame:
    return names.unionByName(learned.select(*names.columns).join(names.select("key"), "key", "left_anti"))


def shared_aliases(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Names of several notes that no note is titled with."""
    many = names.groupBy("key").agg(F.countDistinct("note_id").alias("n_notes"), F.min("note_id").alias("first_note")).where("n_notes > 1")
    return many.join(titles.select("key"), "key", "left_anti")


def unresolved(links: DataFrame, targets: DataFrame, file_keys: DataFrame) -> DataFrame:
    """Targets that are no note, no day and no file: entries and the last day, by entries, then target."""
    day = F.expr("try_cast(target AS date)").isNotNull() & F.col("target").rlike(r"^\d{4}-\d\d-\d\d$")
    left = links.where(~day).join(targets.select(F.col("key").alias("target")), "target", "left_anti").join(file_keys.select(F.col("key").alias("target")), "target", "left_anti")
    return left.groupBy("target").agg(F.countDistinct("entry_id").alias("n"), F.max("entry_date").alias("last_date"))


def linked_with(entities: DataFrame, note_id: int) -> DataFrame:
    """Notes that share entries with this one."""
    own = entities.where(F.col("note_id") == note_id).select("entry_id")
    return entities.where(F.col("note_id") != note_id).join(own, "entry_id", "left_semi").groupBy("note_id").agg(F.count("*").alias("n"))


#: Rows of entities that are dealt to a task where pairs are made.
PAIRED_AT_ONCE = 400_000


def _counted_pairs(entities: DataFrame, least: int) -> DataFrame:
    a, b = entities.withColumnRenamed("note_id", "a"), entities.withColumnRenamed("note_id", "b")
    return a.join(b, "entry_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def note_pairs(entities: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of notes that share entries, each pair once. An entry of m links gives m * m pairs: m is what a person writes.

    Most pairs come up once, so counting them where they are made holds all of a task's. Rows of entities are counted first, and
    dealt to tasks of a bounded number; there they are made single and paired without another shuffle.
    """
    tasks = max(1, -(-entities.count() // PAIRED_AT_ONCE))
    return _counted_pairs(entities.repartition(tasks, "entry_id").distinct(), least)


def note_map(entities: DataFrame, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The notes with most entries, and the pairs among them: a task holds no more of these than the chosen notes make."""
    nodes = limited(entities.groupBy("note_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "note_id"), most)
    return nodes, _counted_pairs(entities.join(nodes, "note_id", "left_semi"), least)


def tag_pairs(tags: DataFrame, least: int = 2) -> DataFrame:
    a, b = tags.withColumnRenamed("tag", "tag_a"), tags.withColumnRenamed("tag", "tag_b")
    return a.join(b, "entry_id").where("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def tags_with(tags: DataFrame, tag: str) -> DataFrame:
    own = tags.where(F.col("tag") == tag).select("entry_id")
    return tags.where(F.col("tag") != tag).join(own, "entry_id", "left_semi").groupBy("tag").agg(F.count("*").alias("n"))


def note_outlinks(note_links: DataFrame, targets: DataFrame) -> DataFrame:
    """(note_id, other): notes that a note links; itself left out."""
    rows = note_links.join(targets.select(F.col("key").alias("target"), F.col("note_id").alias("other")), "target")
    return rows.where("note_id <> other").select("note_id", "other").distinct()


#: Of one day's entries, and of the entries that link it, those that meet in one task; pairs that are dealt to a task.
BLOCK, PAIRS_AT_ONCE = 8192, 1 << 26
#: Entries of a list, and rows that are cut into lists at a time. Spark holds all pairs that two lists give before it passes them on.
LIST, LISTED_AT_ONCE = 64, 1 << 20


def _listed(batches):
    """Rows (entry_id, day) as lists of a day's entries, of LIST at most."""
    import numpy as np
    import pyarrow as pa

    def lists(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        day = rows.column("day").cast(pa.int32()).to_numpy()
        order = np.argsort(day, kind="stable")
        starts = np.flatnonzero(np.diff(day[order], prepend=day[order[0]] - 1))
        sizes = np.diff(starts, append=len(order))
        first = np.concatenate([np.arange(s, s + n, LIST) for s, n in zip(starts, sizes, strict=True)])
        ids = rows.column("entry_id").combine_chunks().take(pa.array(order))
        ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), ids)
        return pa.RecordBatch.from_arrays([rows.column("day").combine_chunks().take(pa.array(order[first])), ids], ["day", "ids"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= LISTED_AT_ONCE:
            yield lists(held)
            held, n = [], 0
    if n:
        yield lists(held)


def _lists(rows: DataFrame) -> DataFrame:
    kind = rows.schema["entry_id"].dataType.simpleString()
    return rows.select("entry_id", "day").mapInArrow(_listed, f"day date, ids array<{kind}>")


def _day_named(target: Column) -> Column:
    """The day that a text names as `date_format` writes it, or null."""
    day = target.try_cast("date")
    return F.when(F.date_format(day, "yyyy-MM-dd") == target, day)


def day_links(links: DataFrame, entries: DataFrame, file_keys: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(entry_id, day_entry_id), each pair once: entries linked by their date, or by their file's name. With `of` (entry_id) only the
    links of these.

    As many pairs as there are links and entries of the linked days. They are given as they are met, and not shuffled: links and
    days are made single before they meet, and shuffled as lists of a day's entries. Links that name no day aren't shuffled for it.
    Blocks of a day's links and entries are dealt, so many tasks share a day of many; counts say how, never what is given. Only pairs
    by a file's name, and those of an entry_id with several dates, are compared.
    """
    spark = links.sparkSession
    linked = links.select("entry_id", _day_named(F.col("target")).alias("day")).where("entry_id IS NOT NULL AND day IS NOT NULL")
    written = entries.select("entry_id", _day_named(F.date_format("entry_date", "yyyy-MM-dd")).alias("day")).where("entry_id IS NOT NULL AND day IS NOT NULL")
    counts = linked.groupBy("day").agg(F.count("*").alias("l")).join(written.groupBy("day").agg(F.count("*").alias("e")), "day")
    across, down = (F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("l", "e"))
    large = F.when((F.col("l") > BLOCK) | (F.col("e") > BLOCK), F.struct("day", across, down))
    pairs, large = counts.agg(F.sum(F.col("l").cast("double") * F.col("e")), F.collect_list(large)).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(pairs or 0) // PAIRS_AT_ONCE))
    blocks = F.broadcast(spark.createDataFrame([tuple(x) for x in large], "day date, l int, e int")) if large else None

    if of is not None:
        of = of.select("entry_id")
        links, linked = links.join(of, "entry_id", "left_semi"), linked.join(of, "entry_id", "left_semi")
    dates = written.groupBy("entry_id").agg(F.collect_set("day").alias("days"))
    single = dates.where("size(days) = 1").select("entry_id", F.col("days")[0].alias("day"))
    several = dates.where("size(days) > 1").select("entry_id", F.explode("days").alias("day"))

    def dealt(lists: DataFrame, own: str, other: str) -> DataFrame:
        """Lists by their day and block: each goes to a block of its own side, with every block of the other."""
        if blocks is None:
            return lists.repartition(tasks, "day")
        mine = F.pmod(F.xxhash64(F.col("ids")[0]), F.coalesce(own, F.lit(1)))
        each = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias("theirs")
        rows = lists.join(blocks, "day", "left").select("day", "ids", mine.cast("int").alias("mine"), each)
        return rows.select("day", F.col("mine").alias(own), F.col("theirs").alias(other), "ids").repartition(tasks, "day", "l", "e")

    once = dealt(_lists(linked.repartition("entry_id").distinct()), "l", "e")

    def met(days: DataFrame) -> DataFrame:
        lists = dealt(_lists(days), "e", "l").withColumnRenamed("ids", "day_ids")
        rows = once.join(lists, [c for c in once.columns if c != "ids"]).select(F.explode("ids").alias("entry_id"), "day_ids")
        return rows.select("entry_id", F.explode("day_ids").alias("day_entry_id")).where("entry_id <> day_entry_id")

    keys = file_keys.select(F.col("key").alias("target"), F.col("entry_id").alias("day_entry_id"))
    by_key = links.join(keys, "target").select("entry_id", "day_entry_id")
    named = met(several).union(by_key.where("entry_id <> day_entry_id")).distinct()
    given = by_key.join(single.withColumnRenamed("entry_id", "day_entry_id"), "day_entry_id").join(linked, ["entry_id", "day"]).select("entry_id", "day_entry_id")
    return met(single).union(named.join(given, ["entry_id", "day_entry_id"], "left_anti"))


def find_notes(names: DataFrame, titles: DataFrame, name: str) -> DataFrame:
    """Notes by exact title, else by exact alias, else by a part of a name."""
    wanted = name.strip().lower()
    tiers = (
        titles.where(F.col("key") == wanted).select("note_id", F.lit(1).alias("tier"))
        .union(names.where(F.col("key") == wanted).select("note_id", F.lit(2)))
        .union(names.where(F.contains(F.col("key"), F.lit(wanted))).select("note_id", F.lit(3)))
    )
    best = tiers.agg(F.min("tier").alias("best"))
    return tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).select("note_id", "tier").distinct()


def names_in(texts: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(text_id, note_id, key, start): names that stand in a text as whole words; of overlapping names of other notes the longest.

    A name meets only texts that hold its first word, so no text meets every name.
    """
    from ..functions.text import words

    texts = texts.select("text_id", F.concat(F.lit(" "), words(F.col("text")), F.lit(" ")).alias("body"))
    first = texts.select("text_id", F.explode(F.array_distinct(F.split(F.trim("body"), " "))).alias("word"))
    keys = names.select("note_id", words(F.col("key")).alias("key")).where(F.length("key") >= least).distinct()
    found = keys.withColumn("word", F.split("key", " ")[0]).join(first, "word").join(texts, "text_id")
    found = found.withColumn("start", F.instr("body", F.concat(F.lit(" "), F.col("key"), F.lit(" ")))).where("start > 0")
    found = found.select("text_id", "note_id", "key", "start", (F.col("start") + F.length("key")).alias("end"))
    other = found.select("text_id", F.col("note_id").alias("o_note"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.length("key").alias("o_size"))
    overlaps = (found["text_id"] == other["text_id"]) & (F.col("o_note") != F.col("note_id")) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end")) & (F.col("o_size") > F.length("key"))
    return found.join(other, overlaps, "left_anti").select("text_id", "note_id", "key", F.col("start").cast("long").alias("start"))


#: Words that stand for someone without naming them. A label of such words alone is no name.
NOT_NAMES = (
    "i me my mine myself you your yours he him his she her hers it its we us our ours they them their theirs "
    "this that these those there here the a an and or of to"
).split()


def learned_names(labels: DataFrame, names: DataFrame, least: int = 2, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Labels used for exactly one note in `least` entries, that aren't names yet: the commonest spelling, and the entries.

    `labels` (entry_id, note_id, label).
    """
    from ..functions.text import name_key

    stand_ins = F.forall(F.split("key", " "), lambda w: w.isin(*NOT_NAMES))
    rows = labels.withColumn("key", name_key(F.col("label"))).where((F.length("key") >= 3) & ~F.col("key").isin(*ignored) & ~stand_ins)
    rows = rows.withColumn("shown", F.regexp_replace("label", "['’]s$", ""))
    use = rows.groupBy("key").agg(F.countDistinct("note_id").alias("notes"), F.countDistinct("entry_id").alias("entries"), F.min("note_id").alias("note_id")).where(f"notes = 1 AND entries >= {least}")
    spelled = rows.groupBy("key", "shown").agg(F.count("*").alias("n"))
    best = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "shown"))).where("rank = 1").select("key", F.col("shown").alias("name"))
    return use.join(best, "key").join(names.select("key"), "key", "left_anti").select("note_id", "key", "name", "entries")


def near_keys(keys: DataFrame, least: float = 0.8, letters: int = 4, others: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of unlike keys of `letters` letters or more within an edit distance of (1 - least) of the longer one's length.
    Of keys alone a is the lesser one; with `others` (key) a is of `keys` and b of `others`, and no two of a side are tried.

    Segments: where the longer key may have d edits, the shorter is cut into d + 1 parts, and one part stands unchanged in the longer
    one, at most d places off. Pairs meet by both lengths, the part's number and its text, so none is lost and few are tried.
    """
    sides = keys.select("key", F.lit(0).alias("side"))
    if others is not None:
        sides = sides.union(others.select("key", F.lit(1)))
    rows = sides.select("key", "side", F.length("key").alias("n")).where(F.col("n") >= letters).distinct()
    edits = lambda n: F.floor((1 - F.lit(least)) * n + 1e-9).cast("int")
    start = lambda l, d, i: F.floor(l * i / (d + 1)).cast("int")  # noqa: E731, E741
    longest = F.floor(F.col("n") / least + 1e-9).cast("int")
    meets = F.col("side") if others is None else 1 - F.col("side")
    short = rows.select(F.col("key").alias("short"), "side", F.col("n").alias("l"), F.explode(F.sequence(F.col("n"), F.greatest("n", longest))).alias("n"))
    if others is not None:  # lengths that the other side has
        short = short.join(F.broadcast(rows.select(meets.alias("side"), "n").distinct()), ["side", "n"], "left_semi")
    short = short.withColumn("d", edits(F.col("n"))).where("n - l <= d").select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    first, end = start(F.col("l"), F.col("d"), F.col("i")), start(F.col("l"), F.col("d"), F.col("i") + 1)
    short = short.select("short", "side", "l", "n", "i", F.substr("short", first + 1, end - first).alias("part"))
    long_ = rows.select(F.col("key").alias("long"), meets.alias("side"), "n", edits(F.col("n")).alias("d")).select("*", F.explode(F.sequence(F.greatest(F.col("n") - F.col("d"), F.lit(letters)), F.col("n"))).alias("l"))
    if others is not None:
        long_ = long_.join(F.broadcast(rows.select("side", F.col("n").alias("l")).distinct()), ["side", "l"], "left_semi")
    long_ = long_.select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    size = end - first
    places = F.sequence(F.greatest(F.lit(0), first - F.col("d")), F.greatest(F.least(F.col("n") - size, first + F.col("d")), F.greatest(F.lit(0), first - F.col("d"))))
    long_ = long_.select("long", "side", "l", "n", "i", F.explode(F.array_distinct(F.transform(places, lambda p: F.substr(F.col("long"), p + 1, size)))).alias("part"))
    pairs = short.join(long_, ["side", "l", "n", "i", "part"]).where("short <> long")
    of_short = F.col("short") < F.col("long") if others is None else F.col("side") == 0
    pairs = pairs.select(F.when(of_short, F.col("short")).otherwise(F.col("long")).alias("a"), F.when(of_short, F.col("long")).otherwise(F.col("short")).alias("b"), "n").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= edits(F.col("n"))).select("a", "b", F.col("distance").cast("long").alias("distance"))


#: Fixed values of similar tags: letters of a shared beginning, and of both tags for a ratio; the least ratio.
PREFIX, RATIO_LETTERS, RATIO = 4, 5, 0.85


def _ratios(batches):
    from difflib import SequenceMatcher

    import pyarrow as pa

    for batch in batches:
        found = [round(SequenceMatcher(None, a, b).ratio(), 6) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "ratio"])


def similar_tags(tags: DataFrame) -> DataFrame:
    """(a, b, why) of unlike tags that may be one: plural of the other, the beginning of the other, or much alike in their letters.

    Each test meets by a key: a tag's singular forms, its beginnings, and edit distance (a ratio of RATIO allows no more edits than
    0.3 of the longer tag has letters).
    """
    own = tags.select(F.lower("tag").alias("tag")).distinct()
    pair = lambda rows, why: rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(why).alias("why"))
    forms = F.array_distinct(F.filter(F.array(F.when(F.col("tag").rlike("..ies$"), F.regexp_replace("tag", "ies$", "y")), F.when(F.col("tag").rlike("..es$"), F.regexp_replace("tag", "es$", "")), F.when(F.col("tag").rlike("..s$"), F.regexp_replace("tag", "s$", ""))), lambda x: x.isNotNull()))
    plural = pair(own.select(F.col("tag").alias("x"), F.explode(forms).alias("y")).join(own.select(F.col("tag").alias("y")), "y"), "plural")
    beginnings = F.transform(F.sequence(F.lit(PREFIX), F.length("tag") - 1), lambda k: F.substr(F.col("tag"), F.lit(1), k))
    longer = own.where(F.length("tag") > PREFIX).select(F.col("tag").alias("x"), F.explode(beginnings).alias("y"))
    prefix = pair(longer.join(own.select(F.col("tag").alias("y")), "y"), "prefix")
    near = near_keys(own.where(F.length("tag") >= RATIO_LETTERS).select(F.col("tag").alias("key")), 0.7).select("a", "b")
    alike = near.mapInArrow(_ratios, "a string, b string, ratio double").where(F.col("ratio") >= RATIO).select("a", "b", F.lit("letters").alias("why"))
    return plural.unionByName(prefix).unionByName(alike).groupBy("a", "b").agg(F.max("why").alias("why"))
