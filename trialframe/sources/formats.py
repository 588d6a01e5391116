"""Result files to records: one row per record, held as a variant."""

from __future__ import annotations

import csv
import io
import json
import re as _re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import yaml
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import as_list, broadcast_if_small, col, small_enough
from trialframe.session import cut
from trialframe.sources.tree import matches_any, plain_path

# the YAML helpers travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------- which file goes where

@dataclass(frozen=True)
class Extractor:
    """Files whose name matches one of the patterns."""

    file_regex: str | Sequence[str]

    @property
    def patterns(self) -> list[str]:
        return as_list(self.file_regex)

    def fits(self, name: Column) -> Column:
        return matches_any(name, self.patterns)


@dataclass(frozen=True)
class JsonFiles(Extractor):
    file_regex: str | Sequence[str] = field(default=(r".*\.json$",))


@dataclass(frozen=True)
class YamlFiles(Extractor):
    file_regex: str | Sequence[str] = field(default=(r".*\.yaml$", r".*\.yml$"))


@dataclass(frozen=True)
class CsvFiles(Extractor):
    file_regex: str | Sequence[str] = field(default=(r".*\.csv$",))
    delimiter: str = ","
    #: by default the first row is a header unless ``fieldnames`` are given
    has_header: bool | None = None
    fieldnames: Sequence[str] | None = None


@dataclass(frozen=True)
class ErrorFiles(Extractor):
    file_regex: str | Sequence[str] = field(default=("^stderr.log$",))


@dataclass(frozen=True)
class IgnoredFiles(Extractor):
    file_regex: str | Sequence[str] = field(default=("^stdout.log$",))


def coverage(files: DataFrame, extractors: dict[str, Extractor], name: str = "source_file") -> DataFrame:
    """Add ``n_extractors`` (patterns that match the file) and ``extractor`` (the name of the one that does)."""
    hits = {
        key: sum((matches_any(col(name), [p]).cast("int") for p in e.patterns), F.lit(0)) for key, e in extractors.items()
    }
    chosen = F.coalesce(*[F.when(h > 0, F.lit(key)) for key, h in hits.items()], F.lit(None).cast("string"))
    return files.withColumns({"n_extractors": sum(hits.values(), F.lit(0)), "extractor": chosen})


def uncovered(files: DataFrame, extractors: dict[str, Extractor], name: str = "source_file") -> DataFrame:
    """Files that match no extractor or several; the result must be empty."""
    return coverage(files, extractors, name).filter(F.col("n_extractors") != 1)


def require_coverage(files: DataFrame, extractors: dict[str, Extractor]) -> None:
    wrong = uncovered(files, extractors).select("path", "n_extractors").toLocalIterator()
    shown = "; ".join(f"{r['path']} matches {r['n_extractors']}" for r in wrong)
    if shown:
        raise ValueError(f"every file needs exactly one extractor: {shown}")


# ---------------------------------------------------------------- JSON

def elements(document: Column) -> Column:
    """The records of a parsed document: the elements of a list, or the document itself."""
    as_array = F.try_variant_get(document, "$", "array<variant>")
    return F.coalesce(as_array, F.array(document))


def json_records(docs: DataFrame, content: str = "content") -> DataFrame:
    """Records of JSON documents (an object or a list of objects); adds ``record`` and ``record_no``."""
    kept = [c for c in docs.columns if c != content]
    parsed = docs.select(*[col(c) for c in kept], F.parse_json(col(content)).alias("__doc"))
    return parsed.select(*[col(c) for c in kept], F.posexplode(elements(F.col("__doc"))).alias("record_no", "record"))


def null_records(records: DataFrame, name: str = "record") -> Column:
    """Is the record empty (an empty file or a null element)?"""
    return col(name).isNull() | F.is_variant_null(col(name))


def drop_empty(records: DataFrame) -> DataFrame:
    return records.filter(~null_records(records))


# ---------------------------------------------------------------- YAML

class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 scalars: only true/false are booleans, and times stay text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$",
     "-+.0123456789"),
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
    ("merge", r"^(?:<<)$", "<"),
):


    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", _re.compile(_pattern),
                                  list(_first.replace("\0", "")) + ([""] if "\0" in _first else []))


def _whole_number(loader, node):
    text = loader.construct_scalar(node)
    if text.startswith("0o"):
        return int(text[2:], 8)
    return int(text, 16) if text.startswith("0x") else int(text)


_Loader.add_constructor("tag:yaml.org,2002:int", _whole_number)


def load_yaml(text: str):
    return yaml.load(text, Loader=_Loader)


#: stands for an infinite number until the JSON text is written, where a number beyond all doubles means the same
_INFINITE = "\ue000infinite"


def _plain(value):
    if isinstance(value, float) and value != value:
        return None
    if value in (float("inf"), float("-inf")):
        return ("-" if value < 0 else "") + _INFINITE
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _json_text(text: str) -> str:
    out = json.dumps(_plain(load_yaml(text)), default=str)
    mark = json.dumps(_INFINITE)
    return out.replace(mark, "1e999").replace(mark[0] + "-" + mark[1:], "-1e999")


#: parsing tasks per core
TASKS_PER_CORE = 4


def spread(docs: DataFrame) -> DataFrame:
    """Documents dealt evenly to tasks: many small ones in few files or row groups would be parsed by as few tasks."""
    return docs.repartition(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)


def yaml_records(docs: DataFrame, content: str = "content") -> DataFrame:
    """Records of YAML documents; they are spread over all tasks, as parsing takes far longer than moving them."""
    kept = [c for c in docs.columns if c != content]
    schema = docs.select(*[col(c) for c in kept]).schema.add("record_json", "string")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[content].map(_json_text)
            yield batch[kept].assign(record_json=texts)

    parsed = spread(docs).mapInPandas(parse, schema)
    return json_records(parsed, "record_json")


# ---------------------------------------------------------------- CSV

def csv_rows_of(files: DataFrame, delimiter: str) -> DataFrame:
    """Rows of files whose quoted values span lines; ``files`` has ``__file`` and the whole text, one task reads a file."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["__file"], batch["value"], strict=True):
                rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
                yield pd.DataFrame({"__file": name, "__id": range(len(rows)), "__values": [[v or None for v in r] for r in rows]})

    return files.mapInPandas(parse, "__file string, __id long, __values array<string>")


def csv_records(spark: SparkSession, paths: Sequence[str], spec: CsvFiles = CsvFiles(), check_names: bool = True) -> DataFrame:
    """Records of CSV files as ``(path, record)`` with text values.

    Files may have different headers: the first row of each file names its values by position, unless ``fieldnames`` do.
    Values beyond the names of a row are kept as a list under ``_extra``. Files are read line-wise, so one very large file is
    split over many tasks; only files with a line that leaves a quote open are parsed whole, as their values may hold
    line breaks. An empty field is missing, and blank lines are no records.
    """
    names = spec.fieldnames
    headed = (names is None) if spec.has_header is None else spec.has_header
    pick = matches_any(F.col("_metadata.file_name"), spec.patterns) if check_names else F.lit(True)
    file = F.col("_metadata.file_path").alias("__file")
    lines = spark.read.options(recursiveFileLookup="true").text(list(paths)).filter(pick)
    sizes = lines.select(file, F.size(F.split("value", "\\Q" + spec.delimiter + "\\E")).alias("n"),
                         (F.regexp_count("value", F.lit('"')) % 2 == 1).alias("open"))
    known = cut(sizes.groupBy("__file").agg(F.max("n").alias("__width"), F.bool_or("open").alias("__torn")))
    width, torn = known.agg(F.max(F.when(~F.col("__torn"), F.col("__width"))), F.bool_or("__torn")).first()
    slots = [f"_c{i}" for i in range(max(width or 1, 1))]
    reader = spark.read.options(
        recursiveFileLookup="true", sep=spec.delimiter, header="false", quote='"', escape='"', mode="PERMISSIVE",
        enforceSchema="true").schema(", ".join(f"{c} string" for c in slots))
    rows = reader.csv(list(paths)).filter(pick).select(file, F.monotonically_increasing_id().alias("__id"), F.array(*slots).alias("__values"))
    if torn:
        odd = F.broadcast(known.filter("__torn")) if small_enough(known) else known.filter("__torn")
        whole = spark.read.options(recursiveFileLookup="true").text(list(paths), wholetext=True).filter(pick).select(file, "value")
        rows = rows.join(odd, "__file", "left_anti").unionByName(csv_rows_of(whole.join(odd, "__file", "left_semi"), spec.delimiter))
    filled = F.array_max(F.transform("__values", lambda v, i: F.when(v.isNotNull(), i + 1)))
    rows = rows.withColumn("__values", F.slice("__values", 1, F.coalesce(filled, F.lit(1))))
    if headed or names is None:
        first = cut(rows.groupBy("__file").agg(F.min("__id").alias("__first"), F.min_by("__values", "__id").alias("__names")))
        rows = rows.join(broadcast_if_small(first), "__file")
        if headed:
            rows = rows.filter("__id <> __first")
    numbered = lambda i: F.concat(F.lit("_c"), i.cast("string"))
    if names is not None:
        label = F.array(*[F.lit(n) for n in names])
    elif headed:
        label = F.transform("__names", lambda n, i: F.coalesce(n, numbered(i)))
    else:
        label = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__names"), F.size("__values")) - 1), numbered)
    labelled = rows.withColumn("__label", label)
    pairs = F.transform("__label", lambda n, i: F.struct(n.alias("k"), F.get("__values", i).alias("v")))
    extra = F.filter(F.slice("__values", F.size("__label") + 1, F.greatest(F.size("__values"), F.lit(1))), lambda v: v.isNotNull())
    more = F.when(F.size(extra) > 0, F.array(F.struct(F.lit("_extra").alias("k"), F.to_json(extra).alias("v")))).otherwise(
        F.array().cast("array<struct<k:string,v:string>>"))
    record = F.parse_json(F.to_json(F.map_from_entries(F.concat(pairs, more)), {"ignoreNullFields": "false"}))
    return labelled.select(plain_path(F.col("__file")).alias("path"), record.alias("record"))


# ---------------------------------------------------------------- error files

def error_report(docs: DataFrame, content: str = "content") -> DataFrame:
    """Error files that are not blank, with their text on one line."""
    text = F.translate(col(content), "\n", " ")
    return docs.withColumn("message", F.trim(text)).filter(F.col("message").rlike(r"\S")).drop(content)
