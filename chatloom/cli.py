"""Commands over a folder of exported Markdown.

    python -m chatloom.cli check FOLDER [--allow-partial]    exit 1 if there are no files, one breaks a rule, or a required platform has none
    python -m chatloom.cli index FOLDER OUT                  writes the index snapshot of the folder to OUT
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import validate
from .runtime import ship
from .sources import files


def check(scanned: DataFrame, partial: bool, say=print) -> int:
    """The exit code of checking scanned files (relative_path, basename, markdown); tells each file that breaks a rule, and what is missing."""
    kept = scanned.where(~validate.is_reference_example("basename", "markdown"))
    checked = kept.select("relative_path", validate.platform_of("markdown").alias("platform"), validate.errors_of("basename", "markdown").alias("errors"))
    total = validate.roll_up(checked, () if partial else validate.REQUIRED_PLATFORMS).first()
    for r in checked.where(F.size("errors") > 0).select("relative_path", "errors").orderBy("relative_path").toLocalIterator():
        say(f"{r.relative_path}: {'; '.join(r.errors)}")
    if total.missing:
        say(f"no export of {total.missing}")
    if not total.n_files and scanned.isEmpty():
        say("no Markdown files")
        return 1
    say(f"{total.n_files} files checked, {total.n_failed} failures")
    return int(total.n_failed > 0)


def index(spark: SparkSession, scanned: DataFrame, folder: str, out: str) -> int:
    """Writes the snapshot of scanned files to the file `out`, in any store that Spark reaches; returns how many."""
    found = files.exported_files(scanned)
    text = files.snapshot_json(found, folder).first().json
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(out)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray((text + "\n").encode()))
    finally:
        stream.close()
    return found.count()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chatloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("check")
    one.add_argument("folder")
    one.add_argument("--allow-partial", action="store_true")
    two = commands.add_parser("index")
    two.add_argument("folder")
    two.add_argument("out")
    given = parser.parse_args(arguments)
    spark = ship(SparkSession.builder.getOrCreate())
    try:
        scanned = files.scan_markdown(spark, given.folder)
    except AnalysisException as e:
        print(f"{given.folder} cannot be read: {e.getCondition()}")
        return 1
    if given.command == "check":
        return check(scanned, given.allow_partial)
    print(f"{index(spark, scanned, given.folder, given.out)} files indexed at {given.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
