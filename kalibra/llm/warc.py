"""Merkle fixity audit of WARC replicas, with DataFrame functions alone.

Each replica's tree is built from its own table of records, without the other's.
Records are laid out in archives in the order of their digests.  A leaf is a
range of digests that follow each other in an archive: it hashes its records in
order, each with its offset range within the leaf.  A node hashes its FANOUT
children in order, each with its bytes, so that the offset range of every node
is bound by the hashes above it.  A record that one replica lacks shifts no other
leaf's hash.

Roots are compared first, and only below nodes that differ does the audit go
down, level by level, to the leaves and then the records that differ.

As ranges are of digests, a key that repeats fills no leaf; equal records are
one with a count of copies, whose offsets follow each other.  The number of
archives grows with that of records: a tree has LEVELS levels below its root,
and at most about FANOUT distinct records to a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, table

#: A level is one hexadecimal digit of the digests.
FANOUT, LEVELS = 16, 3


def record(pages: DataFrame) -> Column:
    """The WARC record of a page, null columns as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col("url").cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )


def digested(pages: DataFrame) -> DataFrame:
    """The records (page_id, length, digest) of pages (page_id, url, html)."""
    x = pages.select("page_id", record(pages).alias("x"))
    return x.select("page_id", F.octet_length("x").cast("long").alias("length"), F.sha2(F.col("x").cast("binary"), 256).alias("digest"))


def archive_digits(records: int, levels: int = LEVELS) -> int:
    """The digits that name an archive, so that a leaf has at most about FANOUT records."""
    n = 1
    while FANOUT ** (n + levels + 1) < records:
        n += 1
    return n


def keyed(column: str = "page_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def laid_out(records: DataFrame, digits: int, levels: int = LEVELS) -> DataFrame:
    """(node, page_id, length, copies, digest, within): the distinct records, the leaf that each is in, and its offset there."""
    folded = records.groupBy("page_id", "length", "digest").agg(F.count("*").alias("copies")).withColumn("node", F.substring("digest", 1, digits + levels))
    before = Window.partitionBy("node").orderBy("digest", keyed(), "length").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long")
    return folded.select("node", "page_id", "length", "copies", "digest", within.alias("within"))


def hashed(nodes: DataFrame, entries: Column) -> DataFrame:
    return nodes.agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda x: x["e"]), ",").cast("binary"), 256).alias("hash"))


def parent(node: str = "node") -> Column:
    return F.expr(f"left({node}, length({node}) - 1)")


def trees(leaves: DataFrame, scratch: Scratch, levels: int = LEVELS) -> list[DataFrame]:
    """The levels (node, bytes, hash) of a tree over laid_out() records, from the leaves to the roots."""
    rows = leaves.withColumns({"bytes": F.col("length") * F.col("copies"), "e": F.concat_ws(":", "within", "length", "copies", "digest", keyed())})
    out = [scratch.write(hashed(rows.groupBy("node"), F.struct("within", "digest", keyed().alias("k"), "length", "e")))]
    for _ in range(levels):
        rows = out[-1].withColumn("e", F.concat_ws(":", F.right("node", F.lit(1)), "bytes", "hash"))
        out.append(scratch.write(hashed(rows.groupBy(parent().alias("node")), F.struct("e"))))
    return out


def differing(own: list[DataFrame], other: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(node, start, replica_start): the leaves that differ, found from the roots down, and where they begin in both archives."""
    bad = None
    for a, b in zip(own[::-1], other[::-1]):
        a = a.select("node", F.col("bytes").alias("own_bytes"), F.col("hash").alias("own_hash"))
        b = b.select("node", F.col("bytes").alias("other_bytes"), F.col("hash").alias("other_hash"))
        if bad is None:
            both = a.join(b, "node", "full_outer").withColumns({"start": F.lit(0).cast("long"), "replica_start": F.lit(0).cast("long")})
        else:  # the children of the nodes above that differ
            up = bad.select(F.col("node").alias("up"), F.col("start").alias("s"), F.col("replica_start").alias("r"))
            a, b = (x.join(up.select("up"), parent() == F.col("up"), "left_semi") for x in (a, b))
            both = a.join(b, "node", "full_outer").withColumn("parent", parent()).join(up, F.col("parent") == F.col("up"))
            order = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # at most FANOUT rows
            upto = lambda x: F.coalesce(F.sum(x).over(order), F.lit(0)).cast("long")
            both = both.withColumns({"start": F.col("s") + upto("own_bytes"), "replica_start": F.col("r") + upto("other_bytes")})
        bad = scratch.write(both.where(~F.col("own_hash").eqNullSafe(F.col("other_hash"))).select("node", "start", "replica_start"))
    return bad


def audited(records: DataFrame, replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A replica's damage: (archive, page_id, length, digest, copies, replica_copies, offset, replica_offset, status, root, replica_root) of each distinct record that isn't alike in both.

    Both tables have page_id, length and digest; other columns play no part.  The
    status is missing or extra for records that one side lacks, altered for them
    where the page has both, and copies where only the number differs.  A side
    without the record has 0 copies and a null offset, and one without the whole
    archive a null root.  Null keys, lengths and digests are values like others;
    repeated rows are copies; without differences, as with two empty tables,
    there are no rows.
    """
    scratch = Scratch(records.sparkSession)
    sides = [x.select("page_id", F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.coalesce("digest", F.lit("")).alias("digest")) for x in (records, replica)]
    digits = archive_digits(max(x.count() for x in sides), levels)
    leaves = [scratch.write(laid_out(x, digits, levels)) for x in sides]
    own, other = (trees(x, scratch, levels) for x in leaves)
    bad = differing(own, other, scratch)
    names = ["node", "page_id", "length", "digest"]
    none = F.lit(None).cast("long")
    rows = leaves[0].join(bad, "node").select(*names, "copies", none.alias("replica_copies"), (F.col("start") + F.col("within")).alias("offset"), none.alias("replica_offset"))
    rows = rows.union(leaves[1].join(bad, "node").select(*names, none, "copies", none, F.col("replica_start") + F.col("within")))
    both = rows.groupBy(*names).agg(*[F.max(c).alias(c) for c in ("copies", "replica_copies", "offset", "replica_offset")])
    status = F.when(F.col("copies").isNull(), "extra").when(F.col("replica_copies").isNull(), "missing").otherwise("copies")
    damage = scratch.write(both.where(~F.col("copies").eqNullSafe(F.col("replica_copies"))).withColumns({"status": status, "archive": F.substring("node", 1, digits)}))
    pages = damage.groupBy("page_id").agg(F.bool_or(F.col("status") == "missing").alias("gone"), F.bool_or(F.col("status") == "extra").alias("come"))
    changed = pages.where("gone and come").select(F.col("page_id").alias("p"), F.lit(True).alias("changed"))
    roots = [x[-1].select(F.col("node").alias("archive"), F.col("hash").alias(n)) for x, n in ((own, "root"), (other, "replica_root"))]
    rows = damage.join(changed, F.col("page_id").eqNullSafe(F.col("p")), "left").join(roots[0], "archive", "left").join(roots[1], "archive", "left")
    altered = F.col("changed").isNotNull() & (F.col("status") != "copies")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("copies", "replica_copies")}
    rows = rows.withColumns({**zero, "status": F.when(altered, "altered").otherwise(F.col("status"))})
    return rows.select("archive", "page_id", "length", "digest", "copies", "replica_copies", "offset", "replica_offset", "status", "root", "replica_root")


#: The planted faults by page_id modulo FAULTS: two wrong bytes, a lost record, a truncated one, one under another key, and one stored twice.
FAULTS, WRONG, LOST, CUT, MOVED, TWICE = 101, 13, 29, 57, 71, 83
FAR = 1_000_000_007


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' records that has planted faults, a table of its own."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fault = F.pmod("page_id", F.lit(FAULTS))
    html = F.when(fault == WRONG, F.expr("concat(substring(html, 1, greatest(length(html) - 2, 0)), '??')")).when(fault == CUT, F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    stored = pages.where(F.coalesce(fault, F.lit(-1)) != LOST).select(
        F.when(fault == MOVED, F.col("page_id") + FAR).otherwise(F.col("page_id")).alias("page_id"), "url", html.alias("html"), F.explode(F.array_repeat(F.lit(0), F.when(fault == TWICE, 2).otherwise(1)))
    )
    replica = Scratch(spark).write(digested(stored))
    return audited(digested(pages), replica)


def oracle(levels: int = LEVELS) -> str:
    """The same rows in SQL, for up to FANOUT ** (LEVELS + 2) records."""
    k = "coalesce(page_id::varchar, '')"
    text = "coalesce(html, '')"
    head = ["'WARC/1.1'", "'WARC-Type: resource'", f"'WARC-Record-ID: <urn:page:' || {k} || '>'", "'WARC-Target-URI: ' || coalesce(url, '')", "'Content-Type: text/html'", f"'Content-Length: ' || strlen({text})::varchar"]
    made = " || chr(13) || chr(10) || ".join([*head, "''", text, "''", "''"])
    html = f"case when page_id % {FAULTS} = {WRONG} then substr(html, 1, greatest(length(html) - 2, 0)) || '??' when page_id % {FAULTS} = {CUT} then substr(html, 1, length(html) // 2) else html end"
    sql = f"""
with p0 as (select page_id, url, html from pages),
p1 as (select case when page_id % {FAULTS} = {MOVED} then page_id + {FAR} else page_id end as page_id, url, {html} as html from pages where (page_id % {FAULTS}) is distinct from {LOST} union all select page_id, url, html from pages where page_id % {FAULTS} = {TWICE}),
"""
    for i in (0, 1):
        sql += f"""f{i} as (select page_id, strlen(x)::bigint as length, sha256(x) as digest, count(*)::bigint as copies from (select page_id, {made} as x from p{i}) group by all),
l{i} as (select *, left(digest, 1) as archive, left(digest, {levels + 1}) as node,
    coalesce(sum(length * copies) over (partition by left(digest, {levels + 1}) order by digest, {k}, length rows between unbounded preceding and 1 preceding), 0)::bigint as within,
    coalesce(sum(length * copies) over (partition by left(digest, 1) order by digest, {k}, length rows between unbounded preceding and 1 preceding), 0)::bigint as start from f{i}),
t{i}_0 as (select node, sum(length * copies)::bigint as bytes, sha256(string_agg(within || ':' || length || ':' || copies || ':' || digest || ':' || {k}, ',' order by within, digest, {k}, length)) as hash from l{i} group by node),
"""
        for j in range(levels):
            sql += f"t{i}_{j + 1} as (select left(node, {levels - j}) as node, sum(bytes)::bigint as bytes, sha256(string_agg(right(node, 1) || ':' || bytes || ':' || hash, ',' order by node)) as hash from t{i}_{j} group by all),\n"
    return sql + f"""d as (select coalesce(a.archive, b.archive) as archive, coalesce(a.page_id, b.page_id) as page_id, coalesce(a.length, b.length) as length, coalesce(a.digest, b.digest) as digest, coalesce(a.copies, 0) as copies, coalesce(b.copies, 0) as replica_copies, a.start as "offset", b.start as replica_offset
    from l0 a full join l1 b on a.digest = b.digest and a.length = b.length and a.page_id is not distinct from b.page_id where a.copies is distinct from b.copies),
s as (select *, bool_or(replica_copies = 0) over (partition by page_id) and bool_or(copies = 0) over (partition by page_id) as changed from d)
select s.archive, page_id, length, digest, copies, replica_copies, "offset", replica_offset, case when changed and copies * replica_copies = 0 then 'altered' when copies = 0 then 'extra' when replica_copies = 0 then 'missing' else 'copies' end as status, x.hash as root, y.hash as replica_root
from s left join t0_{levels} x on x.node = s.archive left join t1_{levels} y on y.node = s.archive"""
