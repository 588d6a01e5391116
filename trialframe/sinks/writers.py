"""Writers. Every output is a folder of part files written by the tasks that hold the rows."""

from __future__ import annotations


from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, dtype_of, is_nested, require_columns
from trialframe.operators.aggregate import hashable
from trialframe.operators.jobs import collected
from trialframe.operators.ordered import PLACE, positions


def output_folder(base: str, config_name: str | None = None, flow_name: str | None = None) -> str:
    """``<base>/<config>/<name>``, where either part may be left out."""
    return "/".join([base.rstrip("/"), *[p for p in (config_name, flow_name) if p]])


def write_nothing(df: DataFrame, skip_empty: bool, what: str) -> bool:
    """True when an empty frame is to be skipped; an empty frame is an error otherwise."""
    if not df.isEmpty():
        return False
    if skip_empty:
        return True
    raise ValueError(f"{what}: the frame is empty, so no output is written")


def _sorted(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows in the order of these columns over all part files, missing values last."""
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]) if order_by else df


def write_csv(df: DataFrame, path: str, skip_empty: bool = False, order_by: Sequence[str] = ()) -> None:
    if write_nothing(df, skip_empty, "CSV summary"):
        return
    _sorted(hashable(df), order_by).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, skip_empty: bool = False, partition_by: Sequence[str] = (),
                order_by: Sequence[str] = ()) -> None:
    """Parquet; columns whose names Parquet readers dislike keep their names."""
    if write_nothing(df, skip_empty, "table dump"):
        return
    _sorted(df, order_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


# ---------------------------------------------------------------- LaTeX and HTML

# fixed values: characters with a meaning in LaTeX and HTML
LATEX_ESCAPES = {
    "\\": r"\textbackslash ", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde ", "^": r"\textasciicircum ",
}
HTML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def _escaped(text: Column, escapes: Mapping[str, str]) -> Column:
    """All characters at once, so that replacements are not escaped again."""
    marks = F.lit(text) if isinstance(text, str) else text
    table = F.create_map(*[F.lit(x) for pair in escapes.items() for x in pair])
    letters = F.split(marks, "")
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def _plain_escape(text: str, escapes: Mapping[str, str]) -> str:
    return "".join(escapes.get(c, c) for c in text)


def _shown(df: DataFrame, name: str) -> Column:
    value = F.to_json(col(name)) if is_nested(dtype_of(df, name)) else col(name).cast("string")
    return F.coalesce(value, F.lit("NaN"))


def _numbered_lines(df: DataFrame, order, line: Column, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    body = positions(df, [], order).select(F.col(PLACE).cast("bigint").alias("n"), line.alias("value"))
    spark = df.sparkSession
    top = spark.createDataFrame([(i - len(before), t) for i, t in enumerate(before)], "n bigint, value string")
    end = spark.createDataFrame([(2**62 + i, t) for i, t in enumerate(after)], "n bigint, value string")
    return top.unionByName(body).unionByName(end).orderBy("n").select("value")


def latex_lines(df: DataFrame, order) -> DataFrame:
    """The frame as lines of a LaTeX table, in order."""
    names = df.columns
    cells = F.concat(F.concat_ws(" & ", *[_escaped(_shown(df, n), LATEX_ESCAPES) for n in names]), F.lit(r" \\"))
    head = " & ".join(_plain_escape(n, LATEX_ESCAPES) for n in names) + r" \\"
    return _numbered_lines(df, order, cells, [r"\begin{tabular}{" + "l" * len(names) + "}", r"\toprule", head, r"\midrule"],
                           [r"\bottomrule", r"\end{tabular}"])


def write_latex(df: DataFrame, path: str, order, skip_empty: bool = False) -> None:
    if write_nothing(df, skip_empty, "LaTeX table"):
        return
    latex_lines(df, order).write.mode("overwrite").text(path)


def html_lines(df: DataFrame, order, by: Sequence[str] = ()) -> DataFrame:
    """The frame as lines of an HTML table in order, or one table per value of ``by``."""
    names = [c for c in df.columns if c not in by]
    cells = [F.concat(F.lit("<td>"), _escaped(_shown(df, n), HTML_ESCAPES), F.lit("</td>")) for n in names]
    row = F.concat(F.lit("    <tr>"), *cells, F.lit("</tr>"))
    head = "".join(f"<th>{_plain_escape(n, HTML_ESCAPES)}</th>" for n in names)
    before, after = ["<table>", f"  <thead><tr>{head}</tr></thead>", "  <tbody>"], ["  </tbody>", "</table>"]
    if not by:
        return _numbered_lines(df, order, row, before, after)
    body = positions(df, by, order).select(*[col(b) for b in by], F.col(PLACE).cast("bigint").alias("n"), row.alias("value"))
    frame = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(t).alias("value"))
        for n, t in [*enumerate(before, -len(before)), *enumerate(after, 2**62)]
    ])
    edges = df.select(*[col(b) for b in by]).distinct().select(*[col(b) for b in by], F.inline(frame))
    return body.unionByName(edges).orderBy(*[col(b) for b in by], "n")


def write_html(df: DataFrame, path: str, order, by: Sequence[str] = ()) -> None:
    """One folder with the lines in order, or one folder per value of ``by``."""
    lines = html_lines(df, order, by)
    if by:
        lines.drop("n").write.mode("overwrite").partitionBy(*by).text(path)
    else:
        lines.write.mode("overwrite").text(path)


# ---------------------------------------------------------------- charts

def write_chart_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """The tables behind the drawing, and the plotted data as one HTML table per figure."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("file_name").parquet(f"{path}/{name}")
    data = tables["data"]
    order = [c for c in data.columns if not is_nested(dtype_of(data, c)) and c != "file_name"]
    places = [c for c in ("fig_idx", "row_idx", "col_idx") if c in order]
    write_html(data, f"{path}/html", [*places, *[c for c in order if c not in places]], ["file_name"])


def error_bars(df: DataFrame, x: str, series: str, mean: str, std: str) -> DataFrame:
    """Mean and deviation per point; a missing deviation counts as 0."""
    require_columns(df, [x, series, mean, std], "error bars")
    return df.select(col(x), col(series), col(mean).alias("mean"), F.coalesce(col(std), F.lit(0.0)).alias("std"))


def scatter(df: DataFrame, x: str = "x", y: str = "y", color: str = "color") -> DataFrame:
    require_columns(df, [x, y, color], "scatter")
    return df.select(col(x), col(y), col(color))


# ---------------------------------------------------------------- run tables and states

def write_run_configs(jobs: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One JSON configuration with sorted names per job, in a folder per experiment."""
    names = sorted(c for c in jobs.columns if c not in keys)
    config = F.to_json(F.struct(*[col(n) for n in names])) if names else F.lit("{}")
    jobs.select(*[col(k) for k in keys], config.alias("config")).write.mode("overwrite").partitionBy(
        "exp_name").json(path)


def state_lists(states: DataFrame, page: int = 10_000) -> DataFrame:
    """Job ids per experiment and state as lists in pages of bounded length."""
    ids = ["exp_run", "exp_run_rep"]
    exp = F.concat_ws("/", "suite", "suite_id", "exp_name", "state")
    return collected(states.withColumn("list", exp), "list", ids, ids, page)


def write_states(states: DataFrame, path: str) -> None:
    """Snapshot of all job states: one row per job."""
    states.write.mode("overwrite").partitionBy("exp_name").parquet(path)


