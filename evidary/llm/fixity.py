"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie; a tree over each file has the records as leaves, ordered byte ranges of
``RANGE`` bytes above them, and ``FANOUT`` times larger ranges from level to level up to one root for a file.
Ranges are cut by offset, so damage in place changes one leaf and the nodes on its way up and nothing beside it.
Two replicas compare roots, then only the children of ranges that differ, down to the records.

A node's hash covers its children with their places in order, so a list is gathered for a range only, whose number
of children its bytes or the fan-out bound.  Records with the same file and offset are one leaf: its hash
covers their number, least and greatest digest, and sum.  A null digest counts as an empty one; rows
without a file or an offset are no records.  Files that one side lacks are found record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary.llm.common import durable, stored

RANGE, FANOUT = 1 << 16, 16
#: Pages of neighbouring ids that are written to one WARC file.
PAGES_PER_FILE = 256


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC response record; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def laid_out(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Where the record of each page lies: (page_id, file, offset, length, digest).

    Pages of ``per_file`` neighbouring ids share a file, in the order of id and digest; pages without an id are dealt to files of
    their own by digest.  A page that is there twice is one record, as an archive keeps one.
    """
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select("page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    once = hashed.groupBy("page_id", "digest").agg(F.max("length").alias("length"))
    file = F.when(F.col("page_id").isNull(), F.concat(F.lit("unnamed-"), F.substring("digest", 1, 5))).otherwise(
        F.concat(F.lit("pages-"), F.floor(F.col("page_id") / per_file).cast("string"))
    )
    named = once.withColumn("file", F.concat(file, F.lit(".warc")))
    before = F.expr("sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)") - F.col("length")
    return named.select("page_id", "file", before.alias("offset"), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, hash) of a replica's records (file, offset, digest)."""
    known = records.where(F.col("file").isNotNull() & F.col("offset").isNotNull())
    digest = F.coalesce("digest", F.lit(""))
    number = F.conv(F.substring(F.sha2(digest, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = known.groupBy("file", "offset").agg(F.count("*").alias("n"), F.min(digest).alias("lo"), F.max(digest).alias("hi"), F.sum(number).alias("total"))
    many = F.sha2(F.concat_ws(":", F.col("n").cast("string"), "lo", "hi", F.col("total").cast("string")), 256)
    return sums.select("file", F.col("offset").cast("long").alias("offset"), F.when(F.col("n") == 1, F.col("lo")).otherwise(many).alias("hash"))


def _parents(children: DataFrame, place: str, width: int) -> DataFrame:
    """(file, at, hash) of the ranges of ``width`` children's places."""
    part = F.concat_ws(":", F.col(place).cast("string"), "hash")
    grouped = children.groupBy("file", F.floor(F.col(place) / width).cast("long").alias("at"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), part.alias("part")))).alias("parts")).select(
        "file", "at", F.sha2(F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), 256).alias("hash")
    )


def tree(records: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The leaves and then the levels of ranges of a replica, roots last, each a stored table."""
    made = [stored(leaves(records), f"{name}-leaves")]
    for level in range(levels):
        made.append(stored(_parents(made[-1], "offset" if level == 0 else "at", RANGE if level == 0 else FANOUT), f"{name}-level{level}"))
    return made


def levels_for(most: int) -> int:
    """Levels of ranges until one covers all offsets up to ``most``."""
    levels, span = 1, RANGE
    while span <= most:
        levels, span = levels + 1, span * FANOUT
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, list[int]]:
    """The damaged places: (file, offset, kind, primary_digest, replica_digest), and how many nodes differ in each level.

    ``kind`` is ``changed``, ``missing`` (not in the replica) or ``extra`` (only there).
    """
    most = primary.select("offset").unionByName(replica.select("offset")).agg(F.max("offset").alias("m")).first()["m"]
    levels = levels_for(int(most or 0))
    a, b = tree(primary, levels, "primary"), tree(replica, levels, "replica")
    wrong, counts = None, []
    for level in range(levels, -1, -1):
        place = "at" if level else "offset"
        left = a[level].withColumnRenamed("hash", "primary_digest")
        right = b[level].withColumnRenamed("hash", "replica_digest")
        if wrong is not None:  # only below ranges that differ
            up = F.floor(F.col(place) / (FANOUT if level else RANGE)).cast("long")
            above = wrong.select("file", F.col("at").alias("up"))
            left, right = (side.withColumn("up", up).join(above, ["file", "up"], "left_semi").drop("up") for side in (left, right))
        both = left.join(right, ["file", place], "full_outer")
        wrong = durable(both.where(~F.col("primary_digest").eqNullSafe(F.col("replica_digest"))))
        counts.append(wrong.count())
    kind = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra").otherwise("changed")
    return wrong.select("file", "offset", kind.alias("kind"), "primary_digest", "replica_digest"), counts


def damaged(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """A replica that has suffered: records at the places of ``layout`` (page_id, file, offset, digest of each), hashed from their own bytes.

    Damage follows from id and size of a page: of 97 pages about one has its last character flipped, one is cut in half,
    one is lost, and one is there a second time a byte further on.
    """
    lot = F.pmod(F.col("page_id") * 7 + F.octet_length("html"), F.lit(97))
    body = F.when(lot == 5, F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\u0001")))
    body = body.when(lot == 11, F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    whole = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    head = F.substring_index(whole, "\r\n\r\n", 1)  # the head still states the length it had
    rotten = F.when(lot.isin(5, 11), F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))).otherwise(whole)
    read = pages.select("page_id", F.sha2(whole, 256).alias("was"), F.sha2(rotten, 256).alias("digest"), lot.alias("lot")).distinct()
    placed = read.join(layout.select(F.col("page_id").alias("p"), "file", "offset", F.col("digest").alias("d")), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("was") == F.col("d")))
    left = placed.where(F.coalesce(F.col("lot") != 17, F.lit(True)))
    twice = F.when(F.col("lot") == 23, F.array(F.col("offset"), F.col("offset") + 1)).otherwise(F.array("offset"))
    return left.select("file", F.explode(twice).alias("offset"), "digest")


def audit_pages(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), damage a replica, and locate the damage, with the page that lay there."""
    layout = stored(laid_out(pages), "warc-layout")
    found, _ = audit(layout, damaged(pages, layout))
    return found.join(layout.select("file", "offset", "page_id", "length"), ["file", "offset"], "left")


#: The same places from plain joins: the layout and the damage as above, compared record by record.
SQL = """
WITH rec AS (
  SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, html IS NULL AS no_html,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages
), whole AS (
  SELECT page_id, html, head, gap, sha256(head || gap || html || gap) AS digest, strlen(head || gap || html || gap) AS length,
    CASE WHEN no_html OR page_id IS NULL THEN NULL ELSE (((page_id * 7 + strlen(html)) % 97) + 97) % 97 END AS lot
  FROM rec
), laid AS (
  SELECT *, CASE WHEN page_id IS NULL THEN 'unnamed-' || substr(digest, 1, 5) ELSE 'pages-' || CAST(CAST(floor(page_id / 256) AS BIGINT) AS VARCHAR) END || '.warc' AS file
  FROM whole
), placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM laid
), hurt AS (
  SELECT *, CASE WHEN lot = 17 THEN NULL
    WHEN lot = 5 THEN sha256(head || gap || substr(html, 1, length(html) - 1) || chr(1) || gap)
    WHEN lot = 11 THEN sha256(head || gap || substr(html, 1, length(html) // 2) || gap) ELSE digest END AS replica_digest
  FROM (SELECT page_id, html, head, gap, digest, lot, file, "offset", placed.length AS size FROM placed)
)
SELECT file, "offset", CASE WHEN replica_digest IS NULL THEN 'missing' ELSE 'changed' END AS kind, digest AS primary_digest, replica_digest, page_id, CAST(size AS BIGINT) AS length
FROM hurt WHERE replica_digest IS DISTINCT FROM digest
UNION ALL
SELECT file, "offset" + 1, 'extra', NULL, digest, NULL, NULL FROM hurt WHERE lot = 23
"""
