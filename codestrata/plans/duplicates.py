"""Duplicate and near-duplicate files.

Files with the same content, and contents with the same blocks, behave alike, so only one
file of each group is compared. What is published is, for every file, the leaders of its two
groups (membership), and the pairs of group leaders; the pairs among all files follow by putting each
group's files for its leader. So a content that a third of all files share gives one row for each
file and not one for each pair, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import materialize

BLOCK = 6          # consecutive significant lines in a block
KEEP = 30          # percent; a pair is reported from here on


def significant_lines(text: Column) -> Column:
    normal = F.transform(tx.lines_of(text), tx.normalize_line)
    return F.filter(normal, lambda line: F.length(line) > 3)


def exact_stars(files: DataFrame) -> DataFrame:
    """(file1, file2): every later copy with the first holder of its content."""
    keyed = files.select("file", F.md5("content").alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("file").alias("file1"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keyed.join(first, "digest").filter(F.col("file") != F.col("file1")).select("file1", F.col("file").alias("file2"))


def hashed_blocks(files: DataFrame) -> DataFrame:
    """(file, digest, windows, blocks): one row for every file, null blocks where a file has no window.

    Purely per row: the six-line windows are slices of the line array, so no shuffle is
    needed to build them, and the text goes no further.
    """
    lined = files.select("file", F.unhex(F.md5("content")).alias("digest"), significant_lines(F.col("content")).alias("sig"))
    windows = F.size("sig") - (BLOCK - 1)
    every = F.transform(F.sequence(F.lit(1), windows), lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("sig", i, BLOCK)))))
    return lined.select("file", "digest", F.greatest(windows, F.lit(0)).alias("windows"),
                        F.when(windows > 0, F.array_sort(F.array_distinct(every))).alias("blocks"))


def block_sets(files: DataFrame) -> DataFrame:
    """(file, windows, blocks): window count and distinct block hashes of files that have a window."""
    return hashed_blocks(files).filter("windows > 0").select("file", "windows", "blocks")


def percent(shared: Column, windows: Column) -> Column:
    return F.bround(F.least(shared / windows * 100, F.lit(100.0))).cast("int")


class Groups:
    """Files in groups of one content, and contents in groups of the same blocks and number of windows.

    ``membership``: file, content_leader, block_leader (null without a window); ``leaders``: one row for each block
    group with its windows, blocks, files, contents and inner, the pairs of its files whose contents are equal. A null
    content is in no group: its leaders are null.
    """

    def __init__(self, files: DataFrame) -> None:
        whole = materialize(hashed_blocks(files), "file-blocks")
        contents = whole.filter("digest is not null").groupBy("digest").agg(F.min("file").alias("content_leader"), F.count(F.lit(1)).alias("copies"))
        narrow = whole.select("file", "digest").join(contents, "digest", "left")
        # one row for each content, under its first holder; a repeated file id still gives one
        lead = whole.join(contents.select(F.col("content_leader").alias("file"), "digest", "copies"), ["file", "digest"]).dropDuplicates(["file", "digest"])
        # equal sets of blocks have equal digests of them
        twin = F.sha2(F.concat(F.col("windows").cast("string").cast("binary"), F.array_join(F.transform("blocks", F.hex), ",").cast("binary")), 256)
        lead = materialize(lead.withColumn("twin", F.unhex(twin)).select("file", "windows", "blocks", "copies", "twin"), "contents")
        groups = lead.filter("windows > 0").groupBy("twin").agg(
            F.min("file").alias("leader"), F.sum("copies").alias("files"), F.count(F.lit(1)).alias("contents"),
            F.sum(F.expr("copies * (copies - 1) div 2")).alias("inner"))
        of = lead.filter("windows > 0").select(F.col("file").alias("content_leader"), "twin").join(groups.select("twin", F.col("leader").alias("block_leader")), "twin").drop("twin")
        self.membership = materialize(narrow.join(of, "content_leader", "left").select(
            "file", "content_leader", "block_leader", "copies"), "membership")
        self.leaders = materialize(groups.join(lead.select(F.col("file").alias("leader"), "twin", "windows", "blocks"), ["leader", "twin"]).drop("twin"), "block-leaders")

    def within(self) -> DataFrame:
        """(leader, similarity): groups of several contents, and how similar each two of these are."""
        alike = self.leaders.filter("contents > 1").select("leader", percent(F.size("blocks"), F.col("windows")).alias("similarity"))
        return alike.filter(F.col("similarity") >= KEEP)

    def across(self) -> DataFrame:
        """(file1, file2, similarity) of leaders of different groups that share enough blocks.

        Candidates come from prefix filtering: if two files reach the threshold, the smaller one shares at
        least one of its rarest D - a + 1 blocks (D its distinct blocks, a the overlap the
        threshold asks for). Boilerplate blocks sort last and so rarely produce candidates, yet no pair
        can be missed.
        """
        sets = self.leaders.select(F.col("leader").alias("file"), "windows", "blocks")
        entries = sets.select("file", F.explode("blocks").alias("block"))
        common = entries.groupBy("block").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
        # overlap the smaller file needs: similarity rounds to KEEP from KEEP - 0.5 on
        need = F.ceil(F.col("windows") * F.lit((KEEP - 0.5) / 100))
        rare = entries.join(common, "block").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("holders", "block"))).alias("rare_first"))
        ranked = sets.select("file", "windows", F.size("blocks").alias("n")).join(rare, "file")
        # blocks nobody else holds sort before all of these and share nothing
        ranked = materialize(ranked.withColumn("prefix", (F.size("rare_first") - need + 1).cast("int")).filter(F.size("rare_first") >= 1).select(
            "file", "windows", "prefix", F.transform("rare_first", lambda e: e.block).alias("held")), "ranked-blocks")
        probe = ranked.filter("prefix > 0").select(
            F.col("file").alias("small"), F.col("windows").alias("w"), F.explode(F.expr("slice(held, 1, prefix)")).alias("block"))
        full = ranked.select(F.col("file").alias("large"), F.col("windows").alias("v"), F.explode("held").alias("block"))
        candidates = probe.join(full, "block").filter("v > w or (v = w and large > small)").select("small", "large").distinct()
        held = ranked.select("file", "windows", "held")
        checked = candidates.join(held.select(F.col("file").alias("small"), F.col("windows").alias("w"), F.col("held").alias("mine")), "small").join(
            held.select(F.col("file").alias("large"), F.col("held").alias("theirs")), "large")
        got = checked.select(F.least("small", "large").alias("file1"), F.greatest("small", "large").alias("file2"),
                             percent(F.size(F.array_intersect("mine", "theirs")), F.col("w")).alias("similarity"))
        return got.filter(F.col("similarity") >= KEEP)

    def block_rows(self) -> DataFrame:
        """(file1, file2, similarity) of group leaders; file1 = file2 stands for the different contents of one group."""
        return self.across().unionByName(self.within().select(F.col("leader").alias("file1"), F.col("leader").alias("file2"), "similarity"))

    def report(self) -> DataFrame:
        """(file1, file2, similarity, type): copies with the first holder of their content, and block rows."""
        copies = self.membership.filter("file <> content_leader").select(
            F.col("content_leader").alias("file1"), F.col("file").alias("file2"), F.lit(100).alias("similarity"), F.lit("exact").alias("type"))
        return copies.unionByName(self.block_rows().withColumn("type", F.lit("block")))

    def by_file(self) -> DataFrame:
        """(file, other, similarity, type, n_files): for every file the groups it has duplicates in, and how many there.

        The files meant are those that ``membership`` has under the leader ``other``: for type exact those of its
        content_leader but the file itself, for type block those of its block_leader, less the copies of the file.
        """
        exact = self.membership.filter("copies > 1").select(
            "file", F.col("content_leader").alias("other"), F.lit(100).alias("similarity"), F.lit("exact").alias("type"), (F.col("copies") - 1).alias("n_files"))
        sizes = self.leaders.select("leader", "files")
        mine = self.membership.filter("block_leader is not null").select("file", F.col("block_leader").alias("leader"), "copies")
        rows = materialize(self.across(), "block-pairs")
        both = rows.select(F.col("file1").alias("leader"), F.col("file2").alias("other"), "similarity").unionByName(
            rows.select(F.col("file2").alias("leader"), F.col("file1").alias("other"), "similarity"))
        near = mine.join(both.join(sizes.withColumnRenamed("leader", "other"), "other"), "leader").select(
            "file", "other", "similarity", F.lit("block").alias("type"), F.col("files").alias("n_files"))
        inner = mine.join(self.within().join(sizes, "leader"), "leader").select(
            "file", F.col("leader").alias("other"), "similarity", F.lit("block").alias("type"), (F.col("files") - F.col("copies")).alias("n_files"))
        return exact.unionByName(near).unionByName(inner)

    def totals(self) -> DataFrame:
        """One row: pairs and files of all duplicates, group sizes multiplied out."""
        rows = self.by_file()
        counts = rows.agg((F.coalesce(F.sum("n_files"), F.lit(0)) / 2).cast("long").alias("pairs"))     # each pair is seen from both sides
        files = rows.select("file").distinct().agg(F.count(F.lit(1)).alias("files"))
        return counts.crossJoin(F.broadcast(files))         # one row each
