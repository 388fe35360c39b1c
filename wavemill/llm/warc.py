"""WARC archives: written by Spark's text writer, read by its text reader, and put together by transaction.

A record is a header, an empty line, and a block of ``Content-Length`` bytes. Two line ends and the next record's
version line stand between blocks, so a file is a text whose line separator is the version line with the line end before it
(the other line end is left out, as a reader that looks for a separator that begins twice alike
misses some across its buffers), and Spark splits, commits and recovers it like any other. A block may hold the separator itself; then a piece is
shorter than its header says. Files in which all pieces have their lengths are read piece by piece; in others
the lengths of the pieces (not their bytes) are followed in order through the file, and pieces of one
record are joined again.

A capture is a transaction of several records: what was asked (request), what came (response, or a revisit of an
earlier response with the same payload), and what is known about it (metadata). ``WARC-Concurrent-To`` names other records of the same
transaction. ``assemble`` follows these links in both directions, to any length, until every record
has reached a response or revisit, and emits one nested row for each of these.

Defined cases: null bodies are empty, null addresses have no ``WARC-Target-URI``; characters that would break a header line are
percent-encoded; each row is a capture, so repeated rows are captures of their own; among records of equal payloads of at least
``least`` bytes one with the largest id is the response (null ids are smallest), all others, repeated rows and ids too,
revisit it; records that reach no response or revisit form captures of their own, without one; where
a record reaches several it belongs to the one with the smallest record id; folded header lines are
not supported; a record cut short at the end of a file is given with what there is, ``whole`` false. An
empty table gives empty archives and no captures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, kept, new_folder

CRLF = "\r\n"
BREAK = CRLF + CRLF
#: What is left of the two line ends before a separator.
REST = BREAK[:-1]
#: Groups of equal payloads are spread over so many keys.
SALTS = 16


def _urn(*parts: Column) -> Column:
    """A record id that follows from what is told apart by it."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-"), at(13, 4), F.lit("-"), at(17, 4), F.lit("-"), at(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: str | Column, record_id: Column, block: Column, *lines: Column) -> Column:
    """A whole record as bytes, without what stands between records."""
    head = F.concat(_line("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), _line("WARC-Record-ID", record_id), *lines, _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    return F.concat(head.cast("binary"), block.cast("binary"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> DataFrame:
    """row, id, url, payload (bytes), sha1, kind and target (the response's row for revisits), a row per row of ``pages``.

    Groups of equal payloads meet on their SHA-256, which pre-aggregates before it is
    shuffled; what comes back is spread over ``SALTS`` keys of each group.
    """
    rows = kept(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("first")
    groups = rows.where("same is not null").groupBy("same").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = kept(groups.select("same", F.col("first.row").alias("target")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    found = salted.join(groups, ["same", "salt"], "left")
    revisit = F.col("target").isNotNull() & (F.col("target") != F.col("row"))
    out = found.select("row", "id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("target")).alias("target"))
    out._kept_tables = (rows, groups)
    return out


def write(caught: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", version: str = "1.1", compression: str = "gzip") -> None:
    """Archives of ``captures``: a request, a response or revisit, and a metadata record each, a file per task.

    ``date`` (when they were caught) may be a timestamp in text or the name of a column of such.
    """
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    clean = F.col("url")
    for c in [*range(0x21), 0x7F]:  # what would end a header line, or the address in it
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    row = F.col("row").cast("string")
    main, asked, known = (_urn(F.lit(k), row) for k in ("response", "request", "metadata"))
    when = _line("WARC-Date", F.col(date).cast("string") if date in caught.columns else F.lit(date))
    uri, digest = _line("WARC-Target-URI", clean), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(BREAK))
    is_revisit = F.col("kind") == "revisit"
    profile = F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    answer = F.when(is_revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    path_of = F.coalesce(F.nullif(F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", ""), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_replace(F.coalesce(host, F.lit("")), r"[\x00-\x20\x7F]", ""), F.lit(BREAK))
    fields = _line("id", F.col("id").cast("string"))
    message = lambda kind: _line("Content-Type", F.lit(f"application/http; msgtype={kind}"))
    beside = _line("WARC-Concurrent-To", main)
    records = F.array(
        _record("request", asked, request, when, uri, beside, message("request")),
        _record(F.col("kind"), main, answer, when, uri, digest, _line("WARC-Refers-To", F.when(is_revisit, _urn(F.lit("response"), F.col("target").cast("string")))), _line("WARC-Profile", profile), message("response")),
        _record("metadata", known, fields, when, beside, _line("Content-Type", F.lit("application/warc-fields"))),
    )
    # the separator is the end of one record and the version line of the next; the first record of a file brings its own version line
    lines = caught.select(F.explode(records).alias("record")).select(F.concat(F.lit(f"WARC/{version}{CRLF}").cast("binary"), F.col("record")).cast("string").alias("value"))
    lines.write.option("lineSep", BREAK).option("compression", compression).text(path)


def _between(version: str) -> str:
    return f"\nWARC/{version}{CRLF}"


def _pieces(spark: SparkSession, path: str, version: str) -> DataFrame:
    """file, at (in order within a file), piece (bytes): what stands between separators; not yet records."""
    text = spark.read.option("lineSep", _between(version)).text(path)
    lead = f"WARC/{version}{CRLF}"
    piece = F.col("value").cast("binary")
    begins = F.substring(piece, 1, len(lead)) == F.lit(lead.encode())
    first = begins & (F.col("_metadata.file_block_start") == 0)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.when(first, F.substring(piece, F.lit(len(lead) + 1), F.octet_length("value"))).otherwise(piece).alias("piece"))


def _parts(piece: Column) -> tuple[Column, Column, Column]:
    """Header block, bytes before the block, and declared length."""
    head = F.substring_index(piece.cast("string"), BREAK, 1)
    before = F.octet_length(head) + len(BREAK)
    declared = F.nullif(F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1), F.lit("")).cast("long")
    return head, before, declared


def read(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """The records of all archives below ``path``: file, record_id, type, date, target_uri, concurrent_to (array), refers_to, payload_digest, content_type, block (bytes), whole."""
    pieces = _pieces(spark, path, version)
    head, before, declared = _parts(F.col("piece"))
    size = F.octet_length("piece")
    measured = pieces.select("file", "at", "piece", size.alias("size"), (before + declared).alias("least"))
    ends = lambda tail: (F.col("size") == F.col("least") + len(tail)) & (F.substring("piece", -len(tail), len(tail)) == F.lit(tail.encode()))
    fits = F.coalesce(ends(REST) | ends(BREAK), F.lit(False))  # the last piece of a file still has both line ends
    odd = kept(measured.where(~fits).select("file").distinct())
    if not odd.limit(1).count():
        discard(odd)
        return _parsed(pieces)
    marked = measured.join(odd.withColumn("odd", F.lit(True)), "file", "left")
    held = kept(marked.where("odd").select("file", F.col("at.block").alias("block"), F.col("at.id").alias("id"), "piece", "size", "least"))
    between = _between(version)
    narrow = held.select("file", "block", "id", "size", "least").repartition("file").sortWithinPartitions("file", "block", "id")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list = [None, None]  # a file's rows are consecutive, and its state goes from batch to batch

        def parts() -> Iterator[tuple[object, pd.DataFrame]]:
            for b in batches:
                for f, own in b.groupby("file", sort=False):
                    yield f, own

        for f, own in parts():
            if f != last[0]:
                last[:] = [f, {"begin": None, "need": 0, "have": 0}]
            yield _step(last[1], own, len(between))

    begun = narrow.mapInPandas(follow, "file string, id long, begin long")
    joined = held.join(begun, ["file", "id"]).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "id", "piece"))).alias("of"))  # the pieces of one record
    whole = F.aggregate(F.slice("of", 2, 1 << 30), F.col("of")[0]["piece"], lambda a, p: F.concat(a, F.lit(between.encode()), p["piece"]))
    return _parsed(marked.where("odd is null").select("piece", "file").unionByName(joined.select("file", whole.alias("piece"))))


def _step(state: dict, rows: pd.DataFrame, n_between: int) -> pd.DataFrame:
    """Follow lengths through the next pieces of a file: to each the id of the piece that its record begins with."""
    out = []
    for i, size, least in zip(rows["id"], rows["size"], rows["least"], strict=True):
        if state["begin"] is not None and state["have"] < state["need"]:
            state["have"] += n_between + size
        else:
            state.update(begin=i, need=-1 if pd.isna(least) else int(least), have=size)
        out.append(state["begin"])
    return pd.DataFrame({"file": rows["file"], "id": rows["id"], "begin": out})


def _parsed(pieces: DataFrame) -> DataFrame:
    head, before, declared = _parts(F.col("piece"))
    split = pieces.select("file", head.alias("head"), F.substring("piece", before + 1, F.coalesce(declared, F.octet_length("piece")).cast("int")).alias("block"), declared.alias("declared"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    every = lambda name: F.regexp_extract_all("head", F.lit(rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$"), 1)
    return split.select(
        "file", field("WARC-Record-ID").alias("record_id"), F.lower(field("WARC-Type")).alias("type"), field("WARC-Date").alias("date"), field("WARC-Target-URI").alias("target_uri"),
        every("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("payload_digest"), field("Content-Type").alias("content_type"),
        "block", F.coalesce(F.octet_length("block") == F.col("declared"), F.lit(False)).alias("whole"),
    )


def transactions(records: DataFrame) -> DataFrame:
    """(record_id, capture): for each record that is no response or revisit the smallest id of those that it reaches over concurrent-to links."""
    main = F.col("type").isin("response", "revisit")
    nodes = kept(records.where(F.col("record_id").isNotNull()).select("record_id", main.alias("main"), "concurrent_to"))
    named = nodes.select("record_id", "main", F.explode("concurrent_to").alias("other"))
    kinds = nodes.select("record_id", "main")
    links = named.join(kinds.select(F.col("record_id").alias("other"), F.col("main").alias("other_main")), "other").where(F.col("record_id") != F.col("other"))
    both = links.select("record_id", "main", "other", "other_main").union(links.select("other", "other_main", "record_id", "main"))
    edges = kept(both.where("not main").select("record_id", "other", "other_main").distinct())
    reached = kept(edges.where("other_main").groupBy("record_id").agg(F.min("other").alias("capture")))
    while True:  # once for each link that lies between a record and its response
        open_ = edges.where("not other_main").join(reached.select("record_id"), "record_id", "left_anti")
        more = kept(open_.join(reached.select(F.col("record_id").alias("other"), "capture"), "other").groupBy("record_id").agg(F.min("capture").alias("capture")))
        if not more.limit(1).count():
            discard(more, nodes, edges)
            return reached
        grown = kept(reached.unionByName(more))
        discard(reached, more)
        reached = grown


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, target_uri, date, response (struct: type, refers_to, digest, http, payload_bytes, payload_sha1, payload), requests and metadata (arrays of structs).

    ``digest`` is what the record says, bytes and SHA-1 are those of the payload as it was
    read; all fields are null where a capture has no response or revisit. Payloads are shuffled once, by record id, and not at all where later steps do not use them.
    """
    is_main = F.col("type").isin("response", "revisit")
    http = F.substring_index(F.col("block").cast("string"), BREAK, 1)
    after = F.octet_length(http) + len(BREAK) + 1
    payload = F.substring("block", after, F.octet_length("block"))
    parts = {"type": F.col("type"), "refers_to": F.col("refers_to"), "digest": F.regexp_replace("payload_digest", "(?i)^sha1:", ""), "http": http, "payload_bytes": F.octet_length(payload).cast("long"), "payload_sha1": F.sha1(payload), "payload": payload}
    mains = records.where(is_main).select(F.col("record_id").alias("capture"), "target_uri", "date", *[c.alias(f"_{n}") for n, c in parts.items()])
    others = records.where(~is_main | F.col("type").isNull())
    placed = others.join(transactions(records), "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    one = F.struct("record_id", "type", "date", "target_uri", "content_type", "block")
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, one)))
    grouped = placed.groupBy("capture").agg(of(F.col("type") == "request").alias("requests"), of(F.coalesce(F.col("type") != "request", F.lit(True))).alias("metadata"))
    whole = mains.join(grouped, "capture", "full_outer")
    response = F.struct(*[F.col(f"_{n}").alias(n) for n in parts]).alias("response")
    nothing = lambda c: F.coalesce(F.col(c), F.array())
    return whole.select(F.col("capture").alias("record_id"), F.coalesce("target_uri", F.get(nothing("requests"), 0)["target_uri"]).alias("target_uri"), "date", response, nothing("requests").alias("requests"), nothing("metadata").alias("metadata"))


def archive(pages: DataFrame, **columns) -> str:
    """Write ``pages`` as archives into a folder of their own below the shared one; returns it."""
    path = new_folder(pages.sparkSession)
    caught = captures(pages, **columns)
    write(caught, path)
    discard(*caught._kept_tables)
    return path


def inventory(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures that ``write`` made.

    A response's bytes and digest are those of the payload as it was read; a
    revisit has those of the response that it refers to.
    """
    page = F.regexp_extract(F.get("metadata", 0)["block"].cast("string"), r"(?m)^id: (-?[0-9]+)\r?$", 1)
    rows = assembled.select(
        "record_id", page.try_cast("long").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_to"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_digest"),
    )
    rows = kept(rows)
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    out = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(targets, "refers_to", "left")
    return out.unionByName(again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to")))
