"""Text files, ignore-file sections and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.address import parse_address

#: The marks of a managed section.
BEGIN, END = "# BEGIN managed outputs", "# END managed outputs"
_SECTION = re.compile(f"({re.escape(BEGIN)}.*?){re.escape(END)}", re.DOTALL)


def write_text(lines: DataFrame, path: str) -> None:
    """One line for each row of the single string column."""
    lines.write.mode("overwrite").text(path)


def stream_addresses(found: DataFrame) -> Iterator[str]:
    """Addresses one after the other, without holding all of them."""
    for row in found.select("addr").toLocalIterator():
        yield row.addr


def render_section(entries: DataFrame) -> list[str]:
    """Lines of a managed section, sorted by pattern and address. The target stands on a line of its own before the pattern,
    as a comment has to."""
    rows = entries.select("pattern", "addr").distinct().orderBy("pattern", F.coalesce("addr", F.lit("")))
    return [BEGIN, *(line for r in rows.toLocalIterator() for line in ([f"# {r.addr}"] if r.addr else []) + [r.pattern]), END]


def parse_section(text: str) -> list[tuple[str, str | None]]:
    """(pattern, addr or None) of the managed section in a file's text. Comments that name no target are kept as entries, and so
    is a target's comment without a pattern."""
    found = _SECTION.search(text)
    entries: list[tuple[str, str | None]] = []
    named: str | None = None
    for line in (found[1].splitlines()[1:] if found else []):
        line = line.strip()
        target = _target_of(line)
        if target:
            entries += [(f"# {named}", None)] if named else []
            named = target
        elif line.startswith("#"):
            entries.append((line, None))
        elif line:
            entries.append((line, named))
            named = None
    return entries + ([(f"# {named}", None)] if named else [])


def _target_of(line: str) -> str | None:
    try:
        return str(parse_address(line[1:].strip())) if line.startswith("#") else None
    except ValueError:
        return None


def merge_file(text: str, section: list[str]) -> str:
    """The file's text with its managed section replaced, or added at the end; all else stays as it is, and merging twice changes nothing."""
    block, found = "\n".join(section), _SECTION.search(text)
    if found:
        return text[: found.start()] + block + text[found.end() :]
    gap = "" if not text else "\n" if text.endswith("\n") else "\n\n"
    return text + gap + block + "\n"


def json_report(df: DataFrame) -> DataFrame:
    """Each row as JSON, in `report`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def escape_annotation(column: str):
    """Text for a one-line CI annotation."""
    return F.replace(F.replace(F.replace(F.col(column), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def truncated(column: str, most: int):
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("…"))).otherwise(F.col(column))


def markdown_table(report: DataFrame) -> DataFrame:
    """(line, place): a small report as the lines of a Markdown table for a comment on a change; null is shown as nothing."""
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    head = report.sparkSession.createDataFrame([(bar(report.columns), 0), (bar(["---"] * len(report.columns)), 1)], "line string, place int")
    cells = F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in report.columns))
    return head.unionByName(report.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"), F.lit(2).alias("place")))


def step_outputs(report: DataFrame) -> DataFrame:
    """(line): the columns of a report of one row as name=value, for the outputs of a CI step."""
    return report.select(F.explode(F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in report.columns))).alias("line"))
