"""Wire formats to a column `event` of JSON texts, in DataFrame functions.

Readers of lines take a DataFrame with the column `value` (spark.read.text, readStream or any other); formats whose
lines depend on each other take whole texts with a column `file` and are ordered within each file only. For files that
are larger than a task, `split_lines` reads them in splits, and `multiline_of_splits`, `w3c_of_splits` and
`cells_of_splits` give what the readers of whole texts give: each split tells in a few numbers what it leaves open, a
pass over these tells each split what it begins with, and only then its lines are read as records.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LINES = 500
WORD = r"[A-Za-z0-9_.\-]+"
# Named patterns and whole-line presets of grok expressions, under their public names.
GROK = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "INT": r"[+-]?[0-9]+",
    "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "NUMBER": r"%{BASE10NUM}",
    "POSINT": r"\b[1-9][0-9]*\b",
    "NONNEGINT": r"\b[0-9]+\b",
    "BASE16NUM": r"(?:0[xX])?[0-9a-fA-F]+",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"(?:\"(?:\\.|[^\\\"])*\"|'(?:\\.|[^\\'])*')",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*\b",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "PATH": r"(?:/[^\s?*]*)+",
    "URIPATH": r"(?:/[^\s?#]*)+",
    "URIPATHPARAM": r"%{URIPATH}(?:\?\S*)?",
    "URI": r"[A-Za-z][A-Za-z0-9+.-]*://\S+",
    "EMAILADDRESS": r"[^\s@]+@[^\s@]+",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])",
    "YEAR": r"(?:\d\d){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})?",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE})?)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "JAVACLASS": r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?"
    r"|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|[Ee]merg(?:ency)?|EMERG(?:ENCY)?)",
}
COMMON_LOG = (
    r"%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "
    r"\"%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?\" %{INT:response} (?:%{INT:bytes}|-)"
)
COMBINED_LOG = COMMON_LOG + r"(?: \"%{DATA:referrer}\" \"%{DATA:agent}\")?"
APP_LOG = r"%{TIMESTAMP_ISO8601:timestamp}\s+%{LOGLEVEL:level}\s+\[%{DATA:thread}\]\s+%{NOTSPACE:logger}\s+-\s+%{GREEDYDATA:message}"
CONTAINER_LOG = r"%{TIMESTAMP_ISO8601:timestamp} %{WORD:stream} %{WORD:logtag} %{GREEDYDATA:message}"
PRESETS = {
    **dict.fromkeys(("common_log", "commonapachelog", "apache_common"), COMMON_LOG),
    **dict.fromkeys(("combined_log", "combinedapachelog", "apache_combined", "nginx_access"), COMBINED_LOG),
    **dict.fromkeys(("log4j", "logback"), APP_LOG),
    **dict.fromkeys(("cri", "containerd"), CONTAINER_LOG),
}


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _map_json(names: Column, values: Column) -> Column:
    """A JSON object of texts; of a repeated name the last counts, empty values are left out.

    Names are unlike as a rule, which one pass tells; only where some are alike is each pair held against the later ones.
    """

    def last_ones(pairs: Column) -> Column:
        fresh = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
        unlike = F.size(F.array_distinct(F.transform(pairs, lambda p: p.k))) == F.size(pairs)
        return F.map_from_entries(F.when(unlike, pairs).otherwise(fresh))

    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p.v.isNotNull() & (p.v != ""))
    return F.to_json(_once(pairs, last_ones))


def lines(df: DataFrame) -> DataFrame:
    """Without blank lines and trailing blanks."""
    return df.select(F.rtrim(F.regexp_replace("value", r"[\r\n\t ]+$", "")).alias("value")).filter("value <> ''")


_PRI, _TOKENS, _PAIR = r"^<\d{1,3}>", r"(?:[^\s\"]|\"(?:\\.|[^\"\\])*\"?)+", r"^[A-Za-z_][A-Za-z0-9_.\-]*="


def detect(sample: str) -> str:
    """json, ndjson, syslog, logfmt or text, by the first line that isn't blank; anything unclear is text."""
    first = next((x.strip() for x in sample.splitlines() if x.strip()), "")
    if first[:1] in ("[", "{"):
        return "json" if first[0] == "[" else "ndjson"
    if re.match(_PRI, first):
        return "syslog"
    found = re.findall(_TOKENS, first)
    pairs = sum(bool(re.match(_PAIR, x)) for x in found)
    return "logfmt" if pairs >= 2 and 2 * pairs >= len(found) else "text"


def detected(texts: Column) -> Column:
    """detect() of each text."""
    first = F.trim(F.regexp_extract(texts, r"\S[^\r\n]*", 0))
    found = F.regexp_extract_all(first, F.lit(_TOKENS), F.lit(0))
    pairs = F.size(F.filter(found, lambda x: x.rlike(_PAIR)))
    out = F.when(first.startswith("["), "json").when(first.startswith("{"), "ndjson").when(first.rlike(_PRI), "syslog")
    return out.when((pairs >= 2) & (2 * pairs >= F.size(found)), "logfmt").otherwise("text")


def _opened(data: bytes) -> str:
    """Text of a file, unpacked by its first bytes, whatever its name."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data.decode("utf-8", "replace")


def _binary(spark: SparkSession, path: str, only: str | None, but: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", only) if only else reader).load(path)
    if but:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.filter(~name.rlike("^" + ".*".join(re.escape(x) for x in but.split("*")) + "$"))

    return files.select("path", "content")


def read_texts(spark: SparkSession, path: str, only: str | None = None, but: str | None = None) -> DataFrame:
    """file, value: whole files, unpacked by their first bytes, so each must fit in a task's memory and in 2 GB. Large files
    of line formats are better read by read_pieces(), or by spark.read.text, which splits them. only, but: globs of names to
    take and to leave."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one text at a time
                text = pa.array([_opened(b.column(1)[i].as_py())], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), text], names=["file", "value"])

    return _binary(spark, path, only, but).mapInArrow(run, "file string, value string")


def _unpacked(data: pa.Buffer):
    """A file that gives what _opened() decodes, a block at a time."""
    start, file = data.slice(0, min(4, data.size)).to_pybytes(), pa.BufferReader(data)
    if start[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=file)
    if start == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(file)
    return file


def _pieces(file, size: int):
    """(format, text) of a file's pieces: of detect()'s formats of lines, cut behind the line end before `size` bytes or the
    first one after; of others the whole file."""
    rest, format = b"", None
    while block := file.read(size):
        rest += block
        if format is None:
            at = len(rest) - len(rest.lstrip())
            if at == len(rest) or b"\n" not in rest[at:]:
                continue  # the line that tells isn't there yet
            format = detect(rest.decode("utf-8", "replace"))
        at = rest.rfind(b"\n") + 1 if format in LINE_FORMATS else 0
        if at:
            yield format, rest[:at].decode("utf-8", "replace")
            rest = rest[at:]
    if rest:
        text = rest.decode("utf-8", "replace")
        yield format or detect(text), text


LINE_FORMATS = ("ndjson", "syslog", "logfmt", "text")
PIECE = 4 << 20


def read_pieces(spark: SparkSession, path: str, only: str | None = None, but: str | None = None, size: int = PIECE) -> DataFrame:
    """file, format, value, for parse(): files as read_texts() gives them, but those of line formats, packed or not, in
    pieces of about `size` bytes that end with a line, of the format that the file begins with. A task then holds a file
    as it is stored and one piece, however much it unpacks to."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for format, text in _pieces(_unpacked(content.as_buffer()), size):
                    row = [pa.array([x], pa.string()) for x in (name, format, text)]
                    yield pa.RecordBatch.from_arrays(row, names=["file", "format", "value"])

    return _binary(spark, path, only, but).mapInArrow(run, "file string, format string, value string")


def _lines_of(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.split("value", r"\r?\n")).alias("value"))


def parse(texts: DataFrame, format: str = "auto", year: int = 1970, start: str | None = None, pattern: str = "") -> DataFrame:
    """Events of whole texts (file, value) in a format, or each in the one that it looks like or, for read_pieces(), in its
    `format`. year: of syslog lines without one; start: what opens a record of several lines, in whole texts; pattern: of grok."""
    if start and "format" in texts.columns:
        raise ValueError("records of several lines are not in pieces")
    by_line = {"ndjson": ndjson, "text": text, "logfmt": logfmt, "cef": cef, "syslog": lambda df: syslog(df, year)}
    by_line["grok"] = lambda df: grok(df, pattern)
    whole = {"json": json_document, "w3c": w3c, "csv": lambda df: cells(df, ","), "tsv": lambda df: cells(df, "\t")}

    def one(name: str, df: DataFrame) -> DataFrame:
        if name == "text" and start:
            return multiline(df, start)
        if name in whole:
            return whole[name](df)
        if name not in by_line:
            raise ValueError(f"unknown format {name!r}")
        return by_line[name](_lines_of(df))

    if format != "auto":
        return one(format, texts)
    marked = texts if "format" in texts.columns else texts.withColumn("format", detected(F.col("value")))
    found = [one(x, marked.filter(F.col("format") == x).drop("format")) for x in ("json", "ndjson", "syslog", "logfmt", "text")]
    return reduce(DataFrame.unionByName, found)


def ndjson(df: DataFrame) -> DataFrame:
    return lines(df).select(F.col("value").alias("event"))


def json_document(texts: DataFrame) -> DataFrame:
    """An array of objects or one object per text; elements keep their own JSON text. A text that is neither is one event,
    which events.rows() then calls bad."""
    one = F.ltrim("value").startswith("{")
    elements = F.when(one, F.array("value")).otherwise(F.coalesce(F.from_json("value", "array<string>"), F.array("value")))
    return texts.filter(F.trim("value") != "").select(F.explode(elements).alias("event"))


def text(df: DataFrame) -> DataFrame:
    return lines(df).select(_json({"message": F.col("value")}).alias("event"))


def multiline(texts: DataFrame, start: str, max_lines: int = MAX_LINES) -> DataFrame:
    """A line that `start` fits opens a record; others continue it, up to max_lines; lines before the first stand alone."""
    records = texts.select(F.explode(F.split("value", rf"\r?\n(?=(?:{start.lstrip('^')}))")).alias("record"))
    parts = F.filter(F.split("record", r"\r?\n"), lambda x: F.trim(x) != "")
    opened = F.col("record").rlike("^(?:" + start.lstrip("^") + ")")
    starts = F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0)), F.lit(max_lines))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("parts", i + 1, max_lines), "\n"))
    pieces = records.withColumn("parts", parts).filter(F.size("parts") > 0)
    pieces = pieces.select(F.explode(F.when(opened, runs).otherwise(F.col("parts"))).alias("m"))
    return pieces.select(_json({"message": F.col("m")}).alias("event"))


_LEVEL = r"(?=\d{1,3}>)0*(?:\d{1,2}|1[0-8]\d|19[01])"  # 0 to 191


def syslog(df: DataFrame, year: int) -> DataFrame:
    """RFC 5424, else RFC 3164 with the given year, else the line as message."""
    v = F.col("value")
    new = rf"^<({_LEVEL})>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) ?(?:-|(?:\[(?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+)? ?(.*)$"
    old = rf"^<({_LEVEL})>(\w{{3}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}) (\S+) (?:([^\s:\[]+)(?:\[(\d+)\])?: ?)?(.*)$"
    g = lambda p, i: F.regexp_extract(v, p, i)
    said = lambda x: F.when((x != "-") & (x != ""), x)
    pri = lambda p: g(p, 1).try_cast("int")
    when = F.concat(F.lit(f"{year} "), F.regexp_replace(g(old, 2), " +", " "))
    stamp = F.date_format(F.try_to_timestamp(when, F.lit("yyyy MMM d HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def event(p: str, when: Column, message: Column, names: dict[str, int]) -> Column:
        level = {"priority": pri(p), "facility": F.floor(pri(p) / 8), "severity": pri(p) % 8}
        return _json({"timestamp": when, "message": message, **level, **{n: said(g(p, i)) for n, i in names.items()}})

    five = event(new, said(g(new, 2)), g(new, 7), {"host": 3, "appname": 4, "procid": 5, "msgid": 6})
    three = event(old, stamp, g(old, 6), {"host": 3, "appname": 4, "procid": 5})
    return lines(df).select(F.when(v.rlike(new), five).when(v.rlike(old), three).otherwise(_json({"message": v})).alias("event"))


def logfmt(df: DataFrame) -> DataFrame:
    """key=value and key="quoted value" pairs, as texts; a line without pairs is a message."""
    v, pair = F.col("value"), rf"({WORD})=(\"(?:\\.|[^\"\\])*\"|[^\s\"]*)"
    names, values = (F.regexp_extract_all(v, F.lit(pair), F.lit(i)) for i in (1, 2))
    bare = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    clean = F.transform(values, lambda x: F.when(x.startswith('"'), bare(x)).otherwise(x))
    return lines(df).select(F.when(v.rlike(pair), _map_json(names, clean)).otherwise(_json({"message": v})).alias("event"))


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header; all values are texts and empty cells are left out. sep None: a tab if the header has one."""
    if sep is None:
        first = spark.read.text(path).first()
        sep = "\t" if first and "\t" in first[0] else ","
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', inferSchema=False)
    filled = [F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*filled)).alias("event"))


def _cells(sep: str):
    """A function of a line's column that gives its cells."""
    raw = rf'{sep}("(?:[^"]|"")*"|[^{sep}]*)'
    inside = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    bare = lambda x: F.when(x.startswith('"'), inside(x)).otherwise(x)
    return lambda x: F.transform(F.regexp_extract_all(F.concat(F.lit(sep), x), F.lit(raw), F.lit(1)), bare)


def cells(texts: DataFrame, sep: str) -> DataFrame:
    """CSV or TSV of whole texts, each with a header of its own; cells may be quoted but not broken over lines."""
    row = _cells(sep)
    some = texts.withColumn("l", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""))
    named = some.withColumn("names", row(F.get("l", F.lit(0))))
    rows = named.select("names", F.explode(F.slice("l", 2, 1 << 30)).alias("x")).withColumn("cells", row(F.col("x")))
    return rows.select(_map_json(F.col("names"), F.slice("cells", 1, F.size("names"))).alias("event"))


def grok(df: DataFrame, pattern: str) -> DataFrame:
    """The fields of a grok expression or preset; lines that it doesn't fit are messages."""
    names: list[str] = []

    def expanded(text: str, depth: int = 0) -> str:
        if depth > 10:
            raise ValueError("grok patterns that name each other")

        def one(m: re.Match) -> str:
            if m[1] not in GROK:
                raise ValueError(f"unknown grok pattern {m[1]!r}")
            if m[2]:
                names.append(m[2])
            return ("(" if m[2] else "(?:") + expanded(GROK[m[1]], depth + 1) + ")"

        return re.sub(r"%\{([A-Z0-9_]+)(?::([\w.@-]+))?(?::\w+)?\}", one, text)

    compiled = expanded(re.sub(r"(?<!\\)\((?!\?)", "(?:", PRESETS.get(pattern, pattern)))
    v = F.col("value")
    parts = {n: F.nullif(F.regexp_extract(v, compiled, i), F.lit("")) for i, n in enumerate(names, 1)}
    fields = _json(parts or {"message": v})
    return lines(df).select(F.when(v.rlike(compiled), fields).otherwise(_json({"message": v})).alias("event"))


CEF_NAMES = ("cef_version", "device_vendor", "device_product", "device_version", "signature_id", "message", "severity")


def cef(df: DataFrame) -> DataFrame:
    r"""Seven header fields between unescaped bars, then key=value pairs whose values may hold blanks; rt is the time."""
    v = F.col("value")
    # no choice within a value can be taken back with success, so that runs of plain characters are taken at once
    bar = r"((?:[^|\\]++|\\.)*+)\|"
    shape = "^CEF:" + bar * 7 + "(.*)$"
    clear = lambda x: F.regexp_replace(x, r"\\([|\\=])", "$1")
    pair = r"([\w.\-]+)=((?:(?!$)(?:[^\\=\s]|\\.|\s(?!\s*+[\w.\-]++=)))*+)(?=\s+[\w.\-]+=|$)"
    of = lambda i: F.regexp_extract_all(F.regexp_extract(v, shape, 8), F.lit(pair), F.lit(i))
    given = F.arrays_zip(of(1).alias("k"), F.transform(of(2), lambda x: F.trim(clear(x))).alias("v"))

    def timed(given: Column) -> Column:
        """The pairs, and before them the time if one of them is it."""
        rt = F.slice(F.filter(given, lambda p: p.k == "rt"), 1, 1)
        return F.concat(F.transform(rt, lambda p: F.struct(F.lit("timestamp").alias("k"), p.v.alias("v"))), given)

    head = F.array(*(clear(F.regexp_extract(v, shape, i)) for i in range(1, 8)))
    pairs = F.concat(F.arrays_zip(F.array(*map(F.lit, CEF_NAMES)).alias("k"), head.alias("v")), _once(given, timed))
    fields = _once(pairs, lambda p: F.struct(F.transform(p, lambda x: x.k).alias("k"), F.transform(p, lambda x: x.v).alias("v")))
    parts = lines(df).select("value", F.when(v.rlike(shape), fields).alias("fields"))
    event = F.when(F.col("fields").isNotNull(), _map_json(F.col("fields.k"), F.col("fields.v"))).otherwise(_json({"message": v}))
    return parts.select(event.alias("event"))


def _numbered(texts: DataFrame) -> DataFrame:
    return texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).filter(F.trim("value") != "")


def w3c(texts: DataFrame) -> DataFrame:
    """Lines under the last #Fields: header of their file; `-` is no value; date and time make the timestamp."""
    before = Window.partitionBy("file").orderBy("line")
    fields = F.split(F.trim(F.substring("value", 9, 1 << 20)), r"\s+")
    header = F.last(F.when(F.col("value").startswith("#Fields:"), fields), ignorenulls=True).over(before)
    return _w3c_rows(_numbered(texts).withColumn("names", header))


def _w3c_rows(rows: DataFrame) -> DataFrame:
    """Events of lines (value) under their header (names)."""
    rows = rows.filter(~F.col("value").startswith("#") & F.col("names").isNotNull())
    rows = rows.withColumn("values", F.transform(F.split("value", r"\s+"), lambda x: F.when(x != "-", x)))
    of = lambda n: F.get("values", F.array_position("names", n).cast("int") - 1)
    both = (F.array_position("names", "date") > 0) & (F.array_position("names", "time") > 0)
    stamp = F.when(both, F.concat(of("date"), F.lit("T"), of("time"), F.lit("Z")))
    values = F.concat(F.slice("values", 1, F.size("names")), F.array(stamp))
    return rows.select(_map_json(F.concat("names", F.array(F.lit("timestamp"))), values).alias("event"))


# files in splits


def split_lines(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """file, block, id, value: the lines of files, in the splits that Spark makes of them; id ascends within a split."""
    read = spark.read.option("pathGlobFilter", only) if only else spark.read
    columns = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return read.text(path).select(*columns, F.monotonically_increasing_id().alias("id"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def _with_carried(lines: DataFrame, splits: DataFrame, *names: str) -> DataFrame:
    """Lines, in their order, with what `splits` says of their split; null for splits that it hasn't. It has a row for some
    splits of files that have several, so it is sent to all tasks and lines stay where they were read."""
    return lines.join(F.broadcast(splits.select("file", "block", *names)), ["file", "block"], "left")


def _first_lines(batch: pa.RecordBatch, split: tuple | None, last: int) -> tuple[list[int], tuple | None, int]:
    """Which lines of a batch (file, block, id, ...) are the first of their split; the split and the id that it ends with."""
    n = batch.num_rows
    if not n:
        return [], split, last
    file, block, id_ = (batch.column(i) for i in range(3))
    new = np.ones(n, bool)
    new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
    new[0] = (file[0].as_py(), block[0].as_py()) != split
    ids = id_.to_numpy()
    if (~new & (np.diff(ids, prepend=last) <= 0)).any():
        raise ValueError("lines of splits that are not in the order they were read in")
    return np.flatnonzero(new).tolist(), (file[n - 1].as_py(), block[n - 1].as_py()), int(ids[-1])


_RUN = "file string, start long, block long, whole boolean, m string"
_RUNS = [("file", pa.string()), ("start", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("m", pa.string())]


def _runs(max_lines: int):
    """Lines (file, block, id, value, opens, first, opened) in their order to runs of max_lines lines of a record and the
    lines before any. A run that may go on in another split isn't whole. Of the lines, a task holds a batch and a run."""

    def run(batches):
        split, last, parts, at, opened, out = None, -1, [], 0, None, []

        def give(ended: bool) -> None:
            if parts:
                begin = at - len(parts)
                start = opened + (begin - opened) // max_lines * max_lines
                out.append((*split, start, start == begin and (ended or len(parts) == max_lines), "\n".join(parts)))
                parts.clear()

        def given() -> pa.RecordBatch:
            file, block, start, whole, m = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((file, start, block, whole, m), _RUNS)], names=[n for n, _ in _RUNS])

        for batch in batches:
            firsts, ends, last = _first_lines(batch, split, last)
            firsts = set(firsts)
            for i, (value, opens) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if i in firsts:
                    give(False)
                    split = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                    at, opened = batch.column(5)[i].as_py() or 0, batch.column(6)[i].as_py()
                if opens:
                    give(True)
                    opened = at
                if opened is None:
                    out.append((*split, at, True, value))
                else:
                    if (at - opened) % max_lines == 0:
                        give(True)
                    parts.append(value)
                at += 1
            split = ends
            if out:
                yield given()
        give(False)
        if out:
            yield given()

    return run


def multiline_of_splits(lines: DataFrame, start: str, max_lines: int = MAX_LINES) -> DataFrame:
    """multiline() of split_lines(), in the order that these are read in. Only the runs of lines at the ends of splits meet."""
    some = lines.filter(F.trim("value") != "").withColumn("opens", F.col("value").rlike("^(?:" + start.lstrip("^") + ")"))
    n = F.col("n")
    counted = some.withColumn("n", F.monotonically_increasing_id()).groupBy("file", "block")  # without gaps within a split
    splits = counted.agg(F.count("*").alias("lines"), (F.max(n) - F.max(F.when(F.col("opens"), n)) + 1).alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.withColumn("first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    opened = F.last(F.col("first") + F.col("lines") - F.col("tail"), ignorenulls=True).over(earlier)
    carried = _with_carried(some, splits.withColumn("opened", opened).filter("first > 0"), "first", "opened")
    runs = carried.select("file", "block", "id", "value", "opens", "first", "opened").mapInArrow(_runs(max_lines), _RUN)
    pieces = runs.filter(~F.col("whole")).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("p"))
    whole = runs.filter("whole").select("m").unionByName(pieces.select(F.array_join("p.m", "\n").alias("m")))
    return whole.select(_json({"message": F.col("m")}).alias("event"))


def _under_headers(batches):
    """Lines (file, block, id, value, own, then) in their order to (value, names): the last header in the split, or the one
    from before it."""
    split, last, names = None, -1, None
    for batch in batches:
        firsts, split, last = _first_lines(batch, split, last)
        own, found, which = batch.column(4), [names], np.zeros(batch.num_rows, np.int64)
        changes = sorted({*firsts, *np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist()})
        for i in changes:
            found.append((own[i] if own[i].is_valid else batch.column(5)[i]).as_py())
            which[i] = 1
        names = found[-1]
        headers = pa.array(found, pa.list_(pa.string())).take(pa.array(np.cumsum(which)))
        yield pa.RecordBatch.from_arrays([batch.column(3), headers], names=["value", "names"])


def w3c_of_splits(lines: DataFrame) -> DataFrame:
    """w3c() of split_lines(), in the order that these are read in."""
    own = F.when(F.col("value").startswith("#Fields:"), F.split(F.trim(F.substring("value", 9, 1 << 20)), r"\s+"))
    some = lines.filter(F.trim("value") != "").withColumn("own", own)
    end = F.max_by("own", F.when(F.col("own").isNotNull(), F.col("id")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = some.groupBy("file", "block").agg(end.alias("end")).withColumn("then", F.last("end", ignorenulls=True).over(earlier))
    carried = _with_carried(some, splits.filter("then is not null"), "then")
    rows = carried.select("file", "block", "id", "value", "own", "then").mapInArrow(_under_headers, "value string, names array<string>")
    return _w3c_rows(rows)


def cells_of_splits(lines: DataFrame, sep: str) -> DataFrame:
    """cells() of split_lines(): a file's first line that isn't blank is its header."""
    some = lines.filter(F.trim("value") != "")
    heads = some.groupBy("file").agg(F.min(F.struct("block", "id", "value")).alias("head"))
    rows = some.join(heads, "file").filter((F.col("block") != F.col("head.block")) | (F.col("id") != F.col("head.id")))
    row = _cells(sep)
    cut = rows.select(row(F.col("head.value")).alias("names"), row(F.col("value")).alias("cells"))
    return cut.select(_map_json(F.col("names"), F.slice("cells", 1, F.size("names"))).alias("event"))
