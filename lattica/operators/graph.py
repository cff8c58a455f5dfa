"""Walks over import edges and block trees: one join a level, for all anchors at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import ancestors


def saved(df: DataFrame) -> DataFrame:
    """A table at a checkpoint: lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or "/tmp/checkpoints")
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table as Parquet in the checkpoint folder: lineage ends there, and it takes a fraction of a checkpoint's bytes and only the columns asked for."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dependency_chain(relationships: DataFrame, files: DataFrame, depth: int = 5, limit: int = 25, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor_id, depth, file_id, file_path, path) of the files an anchor's imports lead to.

    ``path`` joins file paths by ' -> '. A file on the way isn't visited again. Per anchor the first ``limit`` by depth, path
    and way are kept, and told level by level: an anchor that has them goes no deeper, so fewer than ``limit`` ways of an
    anchor go on from any level, and of each way's end only the first ``limit`` targets that aren't on the way matter.
    """
    nodes = files.select(F.col("id").alias("target_id"), "file_path")
    first = Window.partitionBy("source_id").orderBy("file_path", "target_id")
    edges = relationships.select("source_id", "target_id").distinct().join(nodes, "target_id")
    edges = saved(edges.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit + depth).drop("_k"))
    start = files.select(F.col("id").alias("anchor_id"), F.col("file_path").alias("path"))
    if anchors is not None:
        start = start.join(anchors.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi")
    level = start.select("anchor_id", F.col("anchor_id").alias("file_id"), "path", F.array("anchor_id").alias("seen"), F.lit(limit).alias("room"))
    mine = Window.partitionBy("anchor_id")
    levels = []
    for d in range(1, depth + 1):
        met = level.select("anchor_id", F.col("file_id").alias("source_id"), "path", "seen", "room").join(edges, "source_id").filter(~F.array_contains("seen", F.col("target_id")))
        ways = met.select(
            "anchor_id", F.lit(d).alias("depth"), F.col("target_id").alias("file_id"), "file_path", F.concat_ws(" -> ", "path", "file_path").alias("path"),
            F.concat("seen", F.array("target_id")).alias("seen"), "room",
        )
        kept = ways.withColumn("_k", F.row_number().over(mine.orderBy("file_path", "path", "seen"))).filter(F.col("_k") <= F.col("room"))
        done = saved(kept.withColumn("room", F.col("room") - F.count("*").over(mine)).drop("_k"))
        levels.append(done.select("anchor_id", "depth", "file_id", "file_path", "path"))
        level = done.filter("room > 0")
    return reduce(DataFrame.unionAll, levels)


def reachable(relationships: DataFrame, files: DataFrame, depth: int, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor_id, depth, file_id): every file that ``depth`` steps or fewer lead to, with its least number of steps; not the anchor itself.

    Each level joins what the level before found anew and leaves out what is known, so its rows are at most one for each (anchor, file).
    """
    edges = saved(relationships.select(F.col("source_id").alias("file_id"), F.col("target_id").alias("_to")).distinct().join(files.select(F.col("id").alias("_to")), "_to", "left_semi"))
    start = files if anchors is None else files.join(anchors.select("id"), "id", "left_semi")
    fresh = start.select(F.col("id").alias("anchor_id"), F.lit(0).alias("depth"), F.col("id").alias("file_id"))
    known = fresh
    for d in range(1, depth + 1):
        step = fresh.join(edges, "file_id").select("anchor_id", F.col("_to").alias("file_id")).distinct()
        fresh = saved(step.join(known.select("anchor_id", "file_id"), ["anchor_id", "file_id"], "left_anti").select("anchor_id", F.lit(d).alias("depth"), "file_id"))
        known = known.unionAll(fresh)
    return known.filter("depth > 0")


def block_paths(blocks: DataFrame, *carried: str) -> DataFrame:
    """(id, ids, path, and the ``carried`` columns of blocks): ids and names from the root down to each block, and the names above it joined by ' > '.

    Pointers double each round until none is left, so depth d takes log2(d) joins, each written. A way up
    ends before a block that is on it already, so cycles end too, and at a parent that isn't there. What is looked
    up are ids and names alone, in the first round not yet as lists.
    """
    at = blocks.select("id", F.col("parent_block_id").alias("up"), F.col("id").alias("ids"), F.col("name").alias("names"), *carried)
    listed = lambda df, *columns: df.withColumns({c: F.array(c) for c in columns})
    held = "array_max(transform(ids2, (x, i) -> if(array_contains(ids, x), i + 1, 0)))"
    first = True
    while not (going := at.filter("up IS NOT NULL")).isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("ids").alias("ids2"), F.col("names").alias("names2"), F.lit(True).alias("found"))
        met, tops = going.join(above, "up", "left"), at.filter("up IS NULL")
        if first:
            met, tops, first = listed(met, "ids", "names", "ids2", "names2"), listed(tops, "ids", "names"), False
        met = met.withColumn("met", F.expr(f"if(found AND arrays_overlap(ids2, ids), {held}, 0)"))
        rest = lambda c: F.when(F.col("found"), F.concat(F.slice(f"{c}2", F.col("met") + 1, F.size(f"{c}2")), c)).otherwise(F.col(c)).alias(c)
        at = written(tops.unionAll(met.select("id", F.when(F.col("met") == 0, F.col("up2")).alias("up"), rest("ids"), rest("names"), *carried)))
    at = listed(at, "ids", "names") if first else at
    return at.select("id", "ids", F.array_join(F.slice("names", F.lit(1), F.size("names") - 1), " > ").alias("path"), *carried)


def block_tree(blocks: DataFrame) -> DataFrame:
    """(id, file_id, parent_block_id, depth, position): the forest of blocks, top ones at depth 1.

    Position counts from 1 among the children of a block, or among the top blocks of a file, by start_line and id.
    Blocks below a parent that isn't there, or on a cycle, are in no tree.
    """
    tops = blocks.filter("parent_block_id IS NULL").select(F.col("id").alias("top"))
    depths = block_paths(blocks).select("id", F.get("ids", F.lit(0)).alias("top"), F.size("ids").cast("long").alias("depth")).join(tops, "top", "left_semi")
    siblings = Window.partitionBy("parent_block_id", F.when(F.col("parent_block_id").isNull(), F.col("file_id"))).orderBy("start_line", "id")
    placed = blocks.select("id", "file_id", "parent_block_id", F.row_number().over(siblings).cast("long").alias("position"))
    return placed.join(depths.select("id", "depth"), "id").select("id", "file_id", "parent_block_id", "depth", "position")


def block_counts(blocks: DataFrame) -> DataFrame:
    """(id, n_blocks): blocks of each tree, its root and all below it."""
    return block_paths(blocks).groupBy(F.get("ids", F.lit(0)).alias("id")).agg(F.count("*").alias("n_blocks"))


def blocks_to_embed(blocks: DataFrame) -> DataFrame:
    """Blocks with content, whatever their parents hold."""
    return blocks.filter(F.trim("content") != "")


def connection_impacts(outgoing: DataFrame, incoming: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """(anchor_id, file_id, file_path, mapping_id, impact_type, technology, match_confidence) of the mappings above 0.5 at either end of a file.

    ``file_id`` is the other end's file. A mapping within one file counts once, as received.
    """
    far = lambda side, key, p: side.select(F.col("id").alias(key), F.col("file_id").alias(f"{p}_file"), F.col("technology_name").alias(f"{p}_technology"))
    met = mappings.filter("match_confidence > 0.5").join(far(outgoing, "sender_id", "o"), "sender_id", "left").join(far(incoming, "receiver_id", "i"), "receiver_id", "left")
    technology = F.coalesce("o_technology", "i_technology", F.lit("Unknown")).alias("technology")
    ends = lambda own, other, kind: (F.col(own).alias("anchor_id"), F.col(other).alias("file_id"), F.col("id").alias("mapping_id"), F.lit(kind).alias("impact_type"), technology, "match_confidence")
    both = met.select(*ends("i_file", "o_file", "receives_from")).unionAll(met.filter("NOT o_file <=> i_file").select(*ends("o_file", "i_file", "sends_to")))
    anchored = both.join(files.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi")
    return anchored.join(files.select(F.col("id").alias("file_id"), "file_path"), "file_id", "left")


def search_scope(relationships: DataFrame, files: DataFrame, outgoing: DataFrame, incoming: DataFrame, mappings: DataFrame, direction: str = "both", depth: int = 2, anchors: DataFrame | None = None) -> DataFrame:
    """(section, anchor_id, file_id, file_path, and of a connection mapping_id, impact_type, technology, match_confidence)
    for imports, importers, chain, whole reversed chain ('impact') and connection impacts of every file, or of ``anchors`` (id)."""
    named = files.select(F.col("id").alias("file_id"), "file_path")
    out = [connection_impacts(outgoing, incoming, mappings, files).withColumn("section", F.lit("connection_impacts"))]
    if direction in ("forward", "both"):
        out.append(relationships.select(F.lit("imports").alias("section"), F.col("source_id").alias("anchor_id"), F.col("target_id").alias("file_id")).join(named, "file_id").distinct())
        out.append(dependency_chain(relationships, files, depth, anchors=anchors).select(F.lit("dependency_chain").alias("section"), "anchor_id", "file_id", "file_path").distinct())
    if direction in ("backward", "both"):
        out.append(relationships.select(F.lit("importers").alias("section"), F.col("target_id").alias("anchor_id"), F.col("source_id").alias("file_id")).join(named, "file_id").distinct())
        back = relationships.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
        out.append(reachable(back, files, depth, anchors).select(F.lit("impact").alias("section"), "anchor_id", "file_id").join(named, "file_id"))
    scope = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)
    if anchors is not None:
        scope = scope.join(anchors.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi")
    return scope.select("section", "anchor_id", "file_id", "file_path", "mapping_id", "impact_type", "technology", "match_confidence")


def _brief(prefix: str = "") -> F.Column:
    return F.struct(F.col(f"{prefix}start_line").alias("start_line"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}type").alias("type"), F.col(f"{prefix}name").alias("name"))


def with_parent(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the columns of ``above`` (one row for each pid) of their parent, or nulls.

    A block without a parent is keyed by its own id, so that such blocks are dealt over all tasks and not to that of the null key.
    """
    keyed = blocks.withColumn("_up", F.coalesce("parent_block_id", "id")).withColumn("_has", F.col("parent_block_id").isNotNull())
    return keyed.join(above, (keyed["_up"] == above["pid"]) & keyed["_has"], "left").drop("pid", "_up", "_has")


def implementation_context(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(block_id, file_id, type, name, start_line, end_line, parent_name, parent_type, file_path) of each block of a file."""
    parents = blocks.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"), F.col("type").alias("parent_type"))
    placed = with_parent(blocks, parents).join(files.select(F.col("id").alias("file_id"), "file_path"), "file_id")
    return placed.select(F.col("id").alias("block_id"), "file_id", "type", "name", "start_line", "end_line", "parent_name", "parent_type", "file_path")


def block_context(blocks: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each block with its file, project, parent, children and siblings, as nested columns."""
    kids = blocks.filter("parent_block_id IS NOT NULL").groupBy(F.col("parent_block_id").alias("pid")).agg(F.array_sort(F.collect_list(_brief())).alias("children"))
    parents = blocks.select(F.col("id").alias("pid"), F.struct("id", "type", "name", "start_line").alias("parent"))
    placed = blocks.join(files.select(F.col("id").alias("file_id"), "file_path", "language", "project_id"), "file_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    down = placed.join(kids, placed["id"] == kids["pid"], "left").drop("pid")
    peers = kids.select("pid", F.col("children").alias("peers"))
    all_ = with_parent(with_parent(down, parents), peers)
    none = F.array().cast("array<struct<start_line:bigint,id:bigint,type:string,name:string>>")
    return all_.select(
        "id", "type", "name", "content", "start_line", "end_line", "file_id", "file_path", "language", "project_name", "parent",
        F.coalesce("children", none).alias("children"), F.coalesce(F.filter("peers", lambda x: x["id"] != F.col("id")), none).alias("siblings"),
    )


def file_context(files: DataFrame, projects: DataFrame, blocks: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each file with its project, block count, imports and importers as lists of ids."""
    n = blocks.groupBy("file_id").agg(F.count("*").alias("block_count"))
    out = relationships.groupBy(F.col("source_id").alias("file_id")).agg(F.array_sort(F.collect_set("target_id")).alias("imports"))
    into = relationships.groupBy(F.col("target_id").alias("file_id")).agg(F.array_sort(F.collect_set("source_id")).alias("importers"))
    base = files.select(F.col("id").alias("file_id"), "file_path", "language", "project_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    none = F.array().cast("array<bigint>")
    return base.join(n, "file_id", "left").join(out, "file_id", "left").join(into, "file_id", "left").select(
        "file_id", "file_path", "language", "project_name", F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("imports", none).alias("imports"), F.coalesce("importers", none).alias("importers")
    )


def with_mapped(connections: DataFrame, mappings: DataFrame, others: DataFrame, incoming: bool) -> DataFrame:
    """Each connection with the list of its mapped counterparts: one join instead of a lookup each."""
    own, far = ("receiver_id", "sender_id") if incoming else ("sender_id", "receiver_id")
    met = mappings.join(others.select(F.col("id").alias(far), F.col("file_id").alias("other_file"), F.col("technology_name").alias("other_technology")), far)
    lists = met.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(far).alias("other_id"), "other_file", "match_confidence"))).alias("mapped"))
    return connections.join(lists, "id", "left")


def list_paths(paths: DataFrame, path_col: str = "file_path", recursive: bool = True) -> DataFrame:
    """Files and, with a closing slash, every directory above them; distinct and in order."""
    files = paths.select(F.col(path_col).alias("path"))
    every = files.unionAll(files.select(F.explode(ancestors("path")).alias("path"))).filter("path NOT IN ('', '/')").distinct()
    return (every if recursive else every.filter("NOT regexp(trim(BOTH '/' FROM path), '/')")).orderBy("path")


def folder_counts(paths: DataFrame, depth: int, path_col: str = "file_path") -> DataFrame:
    """(folder, files) of the folders down to a depth."""
    up = paths.select(F.explode(F.slice(ancestors(F.ltrim(F.col(path_col), F.lit("/"))), 1, depth)).alias("folder"))
    return up.groupBy("folder").agg(F.count("*").alias("files"))


def common_path(paths: DataFrame, by: str, path_col: str = "file_path") -> DataFrame:
    """(by, directory): the longest common directory, from the smallest and the largest path of a group alone."""
    # distinct directories first: they are hashed and fewer than paths, while a smallest array is found by sorting all rows
    parts = F.split(path_col, "/")
    above = paths.select(by, F.slice(parts, 1, F.size(parts) - 1).alias("p")).distinct()
    ends = above.groupBy(by).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    n = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(by, F.array_join(F.slice("a", F.lit(1), n), "/").alias("directory"))


def suffixes(paths: DataFrame, path_col: str, lengths: DataFrame) -> DataFrame:
    """Rows of paths for each number of last components in ``lengths`` (n): with n, the suffix and its hash."""
    parts = F.split(F.ltrim(F.col(path_col), F.lit("/")), "/")
    cut = paths.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).join(lengths, F.col("_n") == F.col("n"))
    suffix = F.array_join(F.slice(parts, F.size(parts) - F.col("n") + 1, F.col("n")), "/")
    return cut.drop("_n").withColumn("suffix", suffix).withColumn("hash", F.xxhash64("suffix"))


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file_id) of each wanted path: equal, else one whose last components are the wanted path; the smallest path of several.

    Files are indexed by the hashes of their last n components, for the few n that wanted paths have, so paths meet by equality:
    files of one name in many folders meet only the paths that they end in.
    """
    plain = F.ltrim("path", F.lit("/"))
    w = wanted.select("path").distinct().withColumn("n", F.size(F.split(plain, "/"))).withColumn("suffix", plain).withColumn("hash", F.xxhash64("suffix"))
    f = suffixes(files.select(F.col("id").alias("file_id"), "file_path"), "file_path", w.select("n").distinct())
    same = (F.col("file_path") == F.col("path")) | F.col("file_path").endswith(F.concat(F.lit("/"), "suffix"))
    hit = w.join(f.drop("n"), ["hash", "suffix"]).filter(same)
    best = hit.groupBy("path").agg(F.min_by("file_id", F.struct(F.col("file_path") != F.col("path"), "file_path", "file_id")).alias("file_id"))
    return w.select("path").join(best, "path", "left")


def file_windows(wanted: DataFrame, files: DataFrame, outgoing: DataFrame, incoming: DataFrame, mappings: DataFrame) -> DataFrame:
    """(path, file_id, file_path, content, start_line, end_line, mappings) of wanted (path, start_line, end_line), a row for each that is found.

    Paths are met as in ``resolve_paths``. Lines are cut to the file's: a start beyond its end gives its last line, an end before the
    start one line; a missing bound is the file's own, and without both the content is whole and the lines are null. Mappings
    are the ids, in order, of those whose sender or receiver is in the file and, if a bound is given, overlaps the lines.
    """
    asked = wanted.select("path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line")).distinct()
    met = asked.join(resolve_paths(wanted, files).filter("file_id IS NOT NULL"), "path").join(files.select(F.col("id").alias("file_id"), "file_path", "content"), "file_id")
    rows = F.split("content", "\n")
    total, some = F.size(rows), F.col("start_line").isNotNull() | F.col("end_line").isNotNull()
    low = F.greatest(F.lit(0), F.least(F.coalesce(F.col("start_line") - 1, F.lit(0)), total - 1))
    high = F.greatest(low + 1, F.least(F.coalesce("end_line", total), total))
    cut = F.when(some & (F.col("content") != ""), F.array_join(F.slice(rows, low + 1, high - low), "\n")).otherwise(F.col("content"))
    shown = met.select(
        "path", "file_id", "file_path", cut.alias("content"), F.when(some, F.coalesce("start_line", F.lit(1))).alias("start_line"), F.when(some, F.coalesce("end_line", total)).alias("end_line"),
        F.xxhash64("path", "start_line", "end_line").alias("_key"),
    )
    end = lambda side, key: mappings.join(side.select(F.col("id").alias(key), "file_id", F.col("start_line").alias("_a"), F.col("end_line").alias("_b")), key).select(F.col("id").alias("_m"), "file_id", "_a", "_b")
    ends = end(outgoing, "sender_id").unionAll(end(incoming, "receiver_id"))
    over = F.col("start_line").isNull() | (F.coalesce("_a", F.lit(0)) <= F.col("end_line")) & (F.col("start_line") <= F.coalesce("_b", F.lit(2**31 - 1)))
    found = shown.select("_key", "file_id", "start_line", "end_line").join(ends, "file_id").filter(over).groupBy("_key").agg(F.array_sort(F.collect_set("_m")).alias("mappings"))
    return shown.join(found, "_key", "left").drop("_key").withColumn("mappings", F.coalesce("mappings", F.array().cast("array<bigint>")))


def block_summary(wanted: DataFrame, files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, file_id, block_id, type, name, start_line, end_line, above, position) of the blocks of wanted paths' files, met as in
    ``resolve_paths``: ``above`` joins the names of the blocks around by ' > ', position counts in the order of lines."""
    met = resolve_paths(wanted, files).filter("file_id IS NOT NULL")
    narrow = blocks.select("id", "file_id", "type", "name", "start_line", "end_line", "parent_block_id")
    held = written(narrow.join(met.select("file_id").distinct(), "file_id", "left_semi"))
    paths = block_paths(held, "file_id", "type", "name", "start_line", "end_line").withColumnRenamed("path", "above")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id"))
    rows = paths.drop("ids").withColumn("position", place.cast("long"))
    return met.join(rows, "file_id").select("path", "file_id", F.col("id").alias("block_id"), "type", "name", "start_line", "end_line", "above", "position")


def scope_of_paths(wanted: DataFrame, relationships: DataFrame, files: DataFrame, outgoing: DataFrame, incoming: DataFrame, mappings: DataFrame, depth: int = 5) -> DataFrame:
    """``search_scope`` of wanted paths' files, with the path; met as in ``resolve_paths``."""
    met = resolve_paths(wanted, files).filter("file_id IS NOT NULL")
    anchors = saved(met.select(F.col("file_id").alias("id")).distinct())
    return met.select("path", F.col("file_id").alias("anchor_id")).join(search_scope(relationships, files, outgoing, incoming, mappings, depth=depth, anchors=anchors), "anchor_id")


def unmapped(connections: DataFrame, mapped: DataFrame) -> DataFrame:
    """Connections (direction, file_id, other_file_id, …) whose two files no mapping (sender_file, receiver_file) holds in their direction.

    A mapping of a file with itself counts for what the file receives only; a connection without a known other file stays.
    """
    pairs = mapped.filter("sender_file IS NOT NULL AND receiver_file IS NOT NULL")
    taken = pairs.select(F.lit("incoming").alias("direction"), F.col("receiver_file").alias("file_id"), F.col("sender_file").alias("other_file_id")).unionAll(
        pairs.filter("sender_file <> receiver_file").select(F.lit("outgoing"), "sender_file", "receiver_file")
    )
    return connections.join(taken.distinct(), ["direction", "file_id", "other_file_id"], "left_anti")


def longest_prefix(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project): the project with the longest directory above a path. Equi-join on the path's ancestors.

    Paths are dealt over tasks before anything is grouped, as one file of paths may be one task's, however many it holds; and over a
    number of tasks that stays, as paths alike take few bytes in a shuffle but not in memory.
    """
    asked = paths.select("path").repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").distinct()
    up = asked.select("path", F.explode(F.concat(ancestors("path"), F.array(F.concat("path", F.lit("/"))))).alias("above"))
    p = projects.select(F.concat(F.rtrim("path", F.lit("/")), F.lit("/")).alias("above"), F.col("name"))
    hit = up.join(p, "above").groupBy("path").agg(F.max_by("name", F.struct(F.length("above"), "name")).alias("project"))
    return asked.join(hit, "path", "left")


def parent_project(paths: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project): the project whose files' common directory holds a path; the deepest of several, else null."""
    roots = common_path(files, "project_id").filter("directory <> ''").join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    return longest_prefix(paths, roots.select(F.col("directory").alias("path"), "name"))


#: Connections of a block at most, of either direction, and bytes of its descriptions, about: a file with more is dealt into blocks
#: (fixed values). A task's few blocks stay below the 1 MB up to which Parquet's writer holds a dictionary, so a text is stored once.
CELL_ROWS, CELL_BYTES = 1_024, 1 << 17

#: Blocks of ids that a block of descriptions meets in one task, and rows from which it has a task of its own (fixed values).
STRIP_BLOCKS, TASK_ROWS = 64, 1 << 19


def external_connections(files: DataFrame, incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """(project_id, file_path, language, technology, description, direction, incoming_id, outgoing_id): every incoming connection of a file with
    every outgoing one, or with none.

    Rows are a product within a file, and a row's description comes from one side: the incoming connection, or if it has none, the outgoing one.
    That side leads: its rows are dealt into blocks, each text to one task (once more for each STRIP_BLOCKS blocks that it meets). The other
    side's ids and technologies come to every block in lists of CELL_ROWS, and rows are made where a list meets a block, text by text.
    """
    large_side = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / CELL_ROWS), F.ceil(F.col(size) / CELL_BYTES)).cast("int")
    n_of = lambda condition: F.count(F.when(condition, 1))
    size = F.coalesce(F.sum(F.octet_length("description")), F.lit(0))
    known = lambda side: side.filter("file_id IS NOT NULL")
    n_in = known(incoming).groupBy("file_id").agg(n_of(F.col("description").isNotNull()).alias("n_told"), n_of(F.col("description").isNull()).alias("n_untold"), size.alias("size_in"))
    n_out = known(outgoing).groupBy("file_id").agg(F.count("*").alias("n_out"), size.alias("size_out"))
    both = saved(n_in.join(n_out, "file_id", "full").na.fill(0))
    part = lambda in_leads, led, size, met: F.struct(F.lit(in_leads).alias("in_leads"), F.col(led).alias("n_led"), large_side(led, size).alias("n_a"), F.col(met).alias("n_met"))
    parts = both.select("file_id", "n_told", "n_untold", "n_out", F.inline(F.array(part(True, "n_told", "size_in", "n_out"), part(False, "n_out", "size_out", "n_untold"))))
    parts = parts.withColumn("n_b", F.greatest(F.lit(1), F.ceil(F.col("n_met") / CELL_ROWS)).cast("int")).withColumn("n_s", F.ceil(F.col("n_b") / STRIP_BLOCKS).cast("int"))
    parts = parts.withColumn("made", F.expr("IF(in_leads, n_told > 0, n_untold > 0 OR n_told = 0)")).drop("n_told", "n_untold", "n_out")
    tasks = F.least(F.col("n_a") * F.col("n_s"), F.greatest("n_led", F.lit(1)).cast("double") * F.greatest("n_met", F.lit(1)) / TASK_ROWS)
    # blocks are dealt by hash: about one for a task, and hardly ever eight
    wanted = parts.filter("made").agg(F.sum(tasks)).first()[0] or 0
    n = int(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 100_000)))
    key = ["file_id", "in_leads", "a", "s"]
    # files of more than one block are fewer than the connections by CELL_ROWS times, or than their bytes by CELL_BYTES times
    large = F.broadcast(parts.filter("n_a > 1 OR n_b > 1").select("file_id", "in_leads", "n_a", "n_b", "n_s", "made"))
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))

    def dealt(side: DataFrame, in_leads: bool, *more: str) -> DataFrame:
        rows = known(side).select("file_id", F.lit(in_leads).alias("in_leads"), "id", "technology_name", *more, F.xxhash64("id", "technology_name", "description").alias("h"))
        return rows.join(large, ["file_id", "in_leads"], "left").filter("coalesce(made, true)")

    block = lambda c: F.pmod("h", one(c)).cast("int")
    led = dealt(incoming.filter("description IS NOT NULL"), True, "description").unionAll(dealt(outgoing, False, "description"))
    led = led.select("file_id", "in_leads", block("n_a").alias("a"), every("n_s").alias("s"), F.col("id").alias("led_id"), F.col("technology_name").alias("led_technology"), "description", F.lit(True).alias("led"))
    met = dealt(outgoing, True).unionAll(dealt(incoming.filter("description IS NULL"), False)).withColumn("b", block("n_b"))
    met = met.groupBy("file_id", "in_leads", "b", "n_a", "n_s").agg(F.sort_array(F.collect_list(F.struct("id", "technology_name"))).alias("met"))
    met = met.select("file_id", "in_leads", every("n_a").alias("a"), F.pmod("b", one("n_s")).alias("s"), "met")
    cells = parts.filter("made").join(files.select(F.col("id").alias("file_id"), "project_id", "file_path", "language"), "file_id").withColumn("a", every("n_a")).withColumn("s", every("n_s"))
    cells = cells.select(*key, "n_led", "n_met", "project_id", "file_path", "language")
    # lists are the streamed side: each is gone through for one text after the other, so that equal texts follow each other
    whole = cells.repartition(n, *key).join(met.repartition(n, *key).hint("merge"), key, "left").join(led.repartition(n, *key).hint("merge"), key, "left")
    # a block may hold no row: only a file without any connection of a side has nulls there
    whole = whole.filter("(met IS NOT NULL OR n_met = 0) AND (led OR n_led = 0)").withColumn("met", F.explode_outer("met"))
    ids = {"incoming_id": F.when(F.col("in_leads"), F.col("led_id")).otherwise(F.col("met.id")), "outgoing_id": F.when(F.col("in_leads"), F.col("met.id")).otherwise(F.col("led_id"))}
    technology = F.when(F.col("in_leads"), F.coalesce("led_technology", "met.technology_name")).otherwise(F.coalesce("met.technology_name", "led_technology"))
    rows = whole.select("project_id", "file_path", "language", technology.alias("technology"), "description", *(c.alias(name) for name, c in ids.items())).filter("incoming_id IS NOT NULL OR outgoing_id IS NOT NULL")
    return rows.select("project_id", "file_path", "language", "technology", "description", F.when(F.col("incoming_id").isNotNull(), "incoming").otherwise("outgoing").alias("direction"), "incoming_id", "outgoing_id")
