"""Session CSV directories: Event / Sample / Meta files per session.

Layout: ``<root>/<Condition>/.../<name>_{Event|Sample|Meta}.csv``, ';'-separated,
header row, every column read as text, the text ``NULL`` means missing and a
blank cell is an empty string.

Cells may be quoted and then hold separators, doubled quotes, backslashes and
line breaks.  Files are read in splits (``csv_splits``), a large one by many tasks,
quoted line breaks included.

Files of one kind may carry different headers.  Only the distinct headers reach
the driver; every split knows the header of its file and places its cells by name.

``_ord`` is a long: kind, file (in order of names) and place in the file, from the
top bits down.

File systems that pyarrow cannot open are read by Spark's CSV reader instead:
with one header the folder is scanned as it is; with several it is scanned by
position and every row finds its columns through a (file, header) table.
"""

from __future__ import annotations

import csv
import posixpath
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronoframe.config import META_RENAMES, SLASH_FIELDS, UNDERSCORE_FIELDS
from chronoframe.operators.numbering import dense_row_number
from chronoframe.sources.csv_splits import open_file, read_splits

KIND_RANK = {"Event": 0, "Sample": 1, "Meta": 2}
OTHER_RANK = 7
# bits of _ord below the kind: file number, place in the file
FILE_BITS, PLACE_BITS = 22, 38
FILES_PER_TASK = 100_000  # when file names are numbered
_GLOB_CHARS = re.compile(r"([\[\]{}*?\\])")
_URI = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$"


def _qualified(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """(scheme, authority, path) of a path as its Hadoop file system names it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toUri()
    return uri.getScheme() or "file", uri.getAuthority() or "", uri.getPath().rstrip("/")


def _decoded_path(c: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded; keep a literal '+' intact."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _file_key(decoded: Column) -> Column:
    """One spelling for a file's URI (``file:/x`` and ``file:///x`` are the same)."""
    parts = [F.regexp_extract(decoded, _URI, i) for i in (1, 2, 3)]
    return F.concat_ws("|", *parts)


def _relative_name(decoded: Column, root: tuple[str, str, str]) -> Column:
    """Path as listed from the root's parent: '<root name>/<rest>'; an error for any other file."""
    scheme, authority, path = root
    inside = (
        (F.regexp_extract(decoded, _URI, 1) == scheme)
        & (F.regexp_extract(decoded, _URI, 2) == authority)
        & F.startswith(F.regexp_extract(decoded, _URI, 3), F.lit(path + "/"))
    )
    rest = F.substring(F.regexp_extract(decoded, _URI, 3), F.lit(len(path) + 2), F.length(decoded))
    outside = F.raise_error(F.concat(decoded, F.lit(f" is not under {scheme}://{authority}{path}"))).cast("string")
    return F.when(inside, F.concat(F.lit(posixpath.basename(path) + "/"), rest)).otherwise(outside)


def _escape_glob(path: str) -> str:
    return _GLOB_CHARS.sub(r"\\\1", path)


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def _source(root: str | Sequence[str]) -> str | list[str]:
    return root if isinstance(root, str) else [_escape_glob(p) for p in root]


def _list_files(spark: SparkSession, root: str | Sequence[str], glob: str | None) -> DataFrame | None:
    """Matching files as (uri, size); ``content`` is never selected, so never read."""
    try:
        found = _reader(spark, glob).format("binaryFile").load(_source(root))
        return found.select(F.col("path").alias("uri"), F.col("length").alias("size"))
    except AnalysisException as e:  # an empty match is an empty kind
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _first_lines(spark: SparkSession, files: DataFrame, root, glob: str | None) -> tuple[DataFrame, bool]:
    """(uri, size, header) of each file, and whether pyarrow can open them; if not, a text scan gives the headers."""

    # defined here so that it is shipped to the Python workers by value
    def read_first_lines(batches):
        for pdf in batches:
            heads = []
            for uri in pdf["uri"]:
                with open_file(uri) as f:
                    chunk = b""
                    while b"\n" not in chunk:
                        part = f.read(65536)
                        if not part:
                            break
                        chunk += part
                heads.append(chunk.split(b"\n", 1)[0].decode("utf-8", "replace"))
            yield pdf[["uri", "size"]].assign(header=heads)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = files.repartition(parts).mapInPandas(read_first_lines, "uri string, size long, header string")
    readable = True
    try:
        heads.limit(1).collect()
    except PythonException as e:
        if "Unrecognized filesystem" not in str(e):
            raise
        readable = False
        text = _reader(spark, glob).text(_source(root)).select(
            _decoded_path(F.col("_metadata.file_path")).alias("uri"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
            F.monotonically_increasing_id().alias("row"),
        )
        heads = text.where("block = 0").groupBy("uri", "size").agg(F.min_by("value", "row").alias("header"))
    clean = F.regexp_replace(F.coalesce("header", F.lit("")), "^\ufeff|\r$", "")
    # binaryFile paths are already decoded (unlike _metadata.file_path)
    return heads.select("uri", "size", clean.alias("header")), readable


def _header_columns(line: str, sep: str) -> list[str]:
    """Column names of a header line; repeats get their position as a suffix."""
    names = [h.strip() for h in next(csv.reader([line], delimiter=sep), [])]
    return [n if names.index(n) == i else f"{n}{i}" for i, n in enumerate(names)]


def _missing_as_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text 'NULL' -> missing; blank (read as NULL by Spark) -> ''."""
    return df.withColumns(
        {c: F.when(F.col(c) == "NULL", F.lit(None).cast("string")).otherwise(F.coalesce(F.col(c), F.lit(""))) for c in cols}
    )


def _root_of(spark: SparkSession, root: str | Sequence[str]) -> tuple[str, str, str]:
    if isinstance(root, str):
        return _qualified(spark, root)
    spelled = [_qualified(spark, p) for p in root]
    shared = posixpath.commonpath([posixpath.dirname(p) for _, _, p in spelled])
    return (*spelled[0][:2], posixpath.dirname(shared))


def read_kind(
    spark: SparkSession,
    root: str | Sequence[str],
    kind: str,
    sep: str = ";",
    glob: str | None = None,
    split_bytes: int | None = None,
) -> DataFrame | None:
    """Every ``*<kind>.csv`` under ``root`` as text columns + filename + _ord.

    ``root`` may also be a list of explicit files (S5).  Returns None when no
    file matches.  ``filename`` starts at the root's own name, however the
    root was spelled (relative, with or without scheme).  Files larger than
    ``split_bytes`` are read by several tasks.
    """
    glob = (glob if glob is not None else f"*{kind}.csv") if isinstance(root, str) else None
    files = _list_files(spark, root, glob)
    if files is None:
        return None
    heads, readable = _first_lines(spark, files, root, glob)
    heads = heads.withColumn("tag", _relative_name(F.col("uri"), _root_of(spark, root)))
    heads = dense_row_number(heads, ["tag"], "file_no", start=0, partitions=1 + files.count() // FILES_PER_TASK)
    headers = [r["header"] for r in heads.select("header").distinct().orderBy("header").collect()]
    if not headers:
        return None
    by_header = {h: _header_columns(h, sep) for h in headers}
    names = list(dict.fromkeys(c for h in headers for c in by_header[h]))
    rank = KIND_RANK.get(kind, OTHER_RANK) << (FILE_BITS + PLACE_BITS)
    if not readable:
        return _read_by_position(spark, root, glob, heads, by_header, names, rank, sep)
    fits = (F.col("file_no") < 1 << FILE_BITS) & (F.col("size") < 1 << PLACE_BITS)
    checked = F.when(fits, F.col("file_no")).otherwise(F.raise_error(F.lit("too many or too large files for _ord")).cast("long"))
    tag = F.concat_ws("|", checked.cast("string"), "tag")
    rows = read_splits(heads.select("uri", "size", "header", tag.alias("tag")), names, by_header, sep, split_bytes)
    number = F.shiftleft(F.substring_index("_tag", "|", 1).cast("long"), PLACE_BITS)
    name = F.substring(F.col("_tag"), F.instr("_tag", "|") + 1, F.length("_tag"))
    return rows.select(*_quoted(names), name.alias("filename"), (F.lit(rank) + number + F.col("_place")).alias("_ord"))


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def _read_by_position(spark, root, glob, heads, by_header, names, rank, sep) -> DataFrame:
    """The same rows through Spark's CSV reader; files are not split."""
    headers = list(by_header)
    width = max(len(c) for c in by_header.values())
    # the header line of each file is skipped, cells are read by position
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    reader = _reader(spark, glob).options(**options, multiLine="true", enforceSchema="true")
    rows = reader.schema(schema).csv(_source(root))
    rows = rows.select(
        "*",
        _file_key(_decoded_path(F.col("_metadata.file_path"))).alias("key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    cells = F.array(*schema.names)
    place = [(h, [by_header[h].index(c) if c in by_header[h] else -1 for c in names]) for h in headers]
    places = heads.join(F.broadcast(spark.createDataFrame(place, "header string, place array<int>")), "header")
    keyed = rows.join(places.select(_file_key(F.col("uri")).alias("key"), "place", "file_no", "tag"), "key")
    at = [F.get("place", i) for i in range(len(names))]
    # a column that the file's header lacks stays missing
    value = [F.when(p < 0, F.lit("NULL")).otherwise(F.get(cells, p)) for p in at]
    data = keyed.select(
        *[v.alias(c) for v, c in zip(value, names, strict=True)], F.col("tag").alias("filename"), "file_no", "_row"
    )
    numbered = dense_row_number(data, ["file_no", "_row"], "_ord", start=0)
    out = _missing_as_null(numbered, names)
    return out.select(*_quoted(names), "filename", (F.lit(rank) + F.col("_ord")).alias("_ord"))


def path_fields(
    df: DataFrame,
    col: str = "filename",
    slash_names: Sequence[str] = SLASH_FIELDS,
    underscore_names: Sequence[str] = UNDERSCORE_FIELDS,
    keep: bool = False,
) -> DataFrame:
    """Split a path on '_' (i5..) and on '/' (i0..); short -> NULL, surplus dropped."""
    under = F.split(F.col(col), "_")
    slash = F.split(F.col(col), "/")
    cols = {n: F.get(under, i) for i, n in enumerate(underscore_names)}
    cols.update({n: F.get(slash, i) for i, n in enumerate(slash_names)})
    out = df.withColumns(cols)
    return out if keep else out.drop(col)


def rename_meta(meta: DataFrame, renames: dict[str, str] = META_RENAMES) -> DataFrame:
    """Rename Timestamp/Email/Framecount to Meta*; all or nothing."""
    if not all(c in meta.columns for c in renames):
        return meta
    return meta.withColumnsRenamed(renames)


def session_base(c: Column) -> Column:
    """The path of a session's files without the kind suffix."""
    return F.regexp_replace(c, r"(Event|Sample|Meta)\.csv$", "")


def merge_sessions(meta: DataFrame | None, event: DataFrame | None, sample: DataFrame | None) -> DataFrame:
    """(event UNION sample) LEFT JOIN meta.

    On SessionID (NULL matches NULL) when meta carries any SessionID value,
    else on the session's path.  Other columns present on both sides get the
    suffixes '.x' (log) and '.y' (meta); duplicated meta keys multiply rows.
    """
    logs = [d for d in (event, sample) if d is not None]
    if not logs:
        raise ValueError("no event or sample files")
    log = logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1], allowMissingColumns=True)
    if meta is None:
        return log
    by_id = "SessionID" in meta.columns and meta.where(F.col("SessionID").isNotNull()).limit(1).count() > 0
    if by_id:
        left_key, right_key = F.struct(F.col("SessionID")), F.struct(F.col("SessionID"))
        meta_side = meta
    elif "filename" in meta.columns:
        # meta rows made from the log's own files (S4): match the file exactly
        meta_side = meta.drop("SessionID", "_session_base")
        left_key, right_key = F.struct(F.col("filename")), F.struct(F.col("filename"))
    else:
        if "_session_base" not in meta.columns:
            raise ValueError("meta has no SessionID values and no session path")
        meta_side = meta.drop("SessionID")
        left_key = F.struct(session_base(F.col("filename")))
        right_key = F.struct(F.col("_session_base"))
    key_cols = {"SessionID"} if by_id else ({"filename"} if "filename" in meta_side.columns else set())
    clash = [c for c in meta_side.columns if c in log.columns and c not in key_cols and c != "_session_base"]
    log2 = log.withColumnsRenamed({c: f"{c}.x" for c in clash}).withColumn("_mk", left_key)
    meta2 = meta_side.withColumnsRenamed({c: f"{c}.y" for c in clash}).withColumn("_mk", right_key)
    if by_id:
        meta2 = meta2.drop("SessionID")
    elif "filename" in meta2.columns:
        meta2 = meta2.drop("filename")
    joined = log2.join(meta2, "_mk", "left").drop("_mk", "_session_base")
    return joined


def read_meta(spark: SparkSession, root: str | Sequence[str], kind: str = "Meta", sep: str = ";") -> DataFrame | None:
    """S3: meta files + path fields + renames; keeps the session path for J2."""
    meta = read_kind(spark, root, kind, sep)
    if meta is None:
        return None
    meta = meta.withColumn("_session_base", session_base(F.col("filename"))).drop("_ord")
    return rename_meta(path_fields(meta, "filename"))


def meta_from_paths(log: DataFrame) -> DataFrame:
    """Meta rows from the log's own file names (no meta contents)."""
    files = log.select("filename").distinct()
    meta = path_fields(files, "filename", underscore_names=UNDERSCORE_FIELDS[:5], keep=True)
    return meta.withColumn("_session_base", session_base(F.col("filename"))).withColumn(
        "SessionID", F.lit(None).cast("string")
    )


def read_session_dir(
    spark: SparkSession,
    root: str,
    event: str | None = "Event",
    sample: str | None = "Sample",
    meta: str | None = "Meta",
    sep: str = ";",
    split_bytes: int | None = None,
) -> DataFrame:
    """Load a session directory into one long text log (event U sample) x meta.

    A kind set to None is skipped; without meta files the meta rows come from
    the log's file paths (S4).
    """
    ev = read_kind(spark, root, event, sep, split_bytes=split_bytes) if event else None
    sa = read_kind(spark, root, sample, sep, split_bytes=split_bytes) if sample else None
    logs = [d for d in (ev, sa) if d is not None]
    if not logs:
        raise ValueError(f"no event or sample files under {root}")
    if meta:
        m = read_meta(spark, root, meta, sep)
    else:
        log = logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1], allowMissingColumns=True)
        m = meta_from_paths(log)
    return merge_sessions(m, ev, sa)


def read_session_files(
    spark: SparkSession,
    meta_path: str | Sequence[str],
    event_path: str | Sequence[str],
    sample_path: str | Sequence[str],
    sep: str = ";",
) -> DataFrame:
    """One explicit (meta, event, sample) triple, or lists of such files; same rules as S1."""
    listed = lambda p: [p] if isinstance(p, str) else list(p)
    ev = read_kind(spark, listed(event_path), "Event", sep)
    sa = read_kind(spark, listed(sample_path), "Sample", sep)
    m = read_meta(spark, listed(meta_path), "Meta", sep)
    return merge_sessions(m, ev, sa)
