"""Facts of a program kept as files in a folder or file that Spark can reach, and changes kept as a log.

Files are written and read on the driver, like all fact files: they are for facts of the size of a program. Tables of more
rows are written by their DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from hornspark.engine import Program
from hornspark.lang.parser import parse_unit
from hornspark.lang.syntax import LanguageError
from hornspark.sources.formats import RETRACT, Facts, read_columns, read_rows, write_columns, write_rows
from hornspark.sources.tables import files
from hornspark.values import constant, term

FORMATS = {"rows": (write_rows, read_rows), "columns": (write_columns, read_columns)}


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Whole or not at all: under another name first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.half")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(half, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(half, p):
        raise OSError(f"cannot write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def save(program: Program, path: str, relations: Iterable[str] | None = None, *, form: str = "rows", compress: str | None = None) -> None:
    """All relations of a program, or these, in one file."""
    if form not in FORMATS:
        raise LanguageError(f"no form {form}")
    facts = {n: list(program.relation(n).rows()) for n in (program.relations() if relations is None else relations)}
    write_bytes(program.spark, path, FORMATS[form][0](facts, compress))


def save_query(program: Program, atom: str, path: str, *, form: str = "rows", compress: str | None = None) -> None:
    """The rows that a query gives, as facts of its relation."""
    name = atom.partition("(")[0].strip()
    write_bytes(program.spark, path, FORMATS[form][0]({name: list(program.query(atom).rows())}, compress))


def load(spark: SparkSession, path: str, *, form: str = "rows") -> Facts:
    return FORMATS[form][1](read_bytes(spark, path))


class Log:
    """Changes in a folder, one file for each batch of them, in the order of their numbers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        p = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)

    def _names(self) -> list[str]:
        return [name for name, _, _ in files(self.spark, self.folder) if name.endswith(".mg")]

    def changes(self) -> list[tuple[str, str, tuple]]:
        """insert or retract, relation, rows."""
        out: list[tuple[str, str, tuple]] = []
        for name in self._names():
            for c in parse_unit(self.spark.read.text(name, wholetext=True).first().value).clauses:
                gone = c.head.name.startswith(RETRACT)
                out.append(("retract" if gone else "insert", c.head.name.removeprefix(RETRACT), (tuple(map(constant, c.head.terms)),)))
        return out

    def append(self, changes: Iterable[tuple[str, str, tuple]]) -> None:
        text = program_of(changes)
        if text:
            last = self._names()[-1:] or ["0.mg"]
            n = int(last[0].rpartition("/")[2].removesuffix(".mg")) + 1
            write_bytes(self.spark, f"{self.folder}/{n:012}.mg", text.encode())


def program_of(changes: Iterable[tuple[str, str, tuple]]) -> str:
    """Changes as a program: facts, and facts of __retract__ relations."""
    lines = [f"{RETRACT if what == 'retract' else ''}{n}({', '.join(str(term(v)) for v in r)})." for what, n, rows in changes for r in rows]
    for line in lines:
        parse_unit(line)
    return "\n".join(lines)
