"""A folder with the documents and the index made of them, each a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import latex_tokens
from .operators import postings, search, tables
from .shared import checkpointed
from .sources import snapshot, xml

EQUATIONS = "doi STRING, eqnID STRING, tokens ARRAY<STRING>, canon STRING"
METADATA = "doi STRING, containerID STRING, format STRING, publicationYear STRING, no_eqns INT"

POSTINGS = "gram BIGINT, doi STRING, eqnID STRING"
KEYS = ["doi", "eqnID"]


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.docs, self.index = spark, f"{folder}/documents", f"{folder}/index"

    def init(self) -> None:
        """Empty documents and an empty index, as new versions."""
        snapshot.init(self.spark, self.docs, {"documents": tables.DOCUMENT})
        snapshot.init(self.spark, self.index, {"equations": EQUATIONS, "metadata": METADATA, "postings": POSTINGS})

    def documents(self) -> DataFrame:
        return snapshot.load(self.spark, self.docs, "documents")

    def _save(self, documents: DataFrame) -> None:
        snapshot.save({"documents": documents}, self.docs)

    def _read(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents of files(path, type, content), and (path, error) of those that can't be parsed."""
        rows = checkpointed(xml.rows(files))
        keys = ["doi", "type", "format", "containerID", "publicationYear"]
        good = rows.where("error IS NULL AND doi IS NOT NULL")
        # An equation without an id can't be named by a search; a document without equations still is one.
        full = tables.stored_document(good.where("eqnID IS NOT NULL"), latex_tokens, keys)
        bare = good.select(*keys).distinct().join(full.select("doi", "type"), ["doi", "type"], "left_anti")
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        bare = bare.withColumns({"source": empty, "content": F.transform_values(empty, lambda _, __: F.array().cast("array<string>"))})
        return full.unionByName(bare.select(*full.columns)), rows.where("error IS NOT NULL").select("path", "error")

    def add_files(self, files: DataFrame) -> list[tuple[str, str]]:
        """Puts files(path, type, content) in; errors of single files don't keep out the others."""
        new, errors = self._read(files)
        self._save(tables.upsert(self.documents(), new.select(*self.documents().columns)))
        return [tuple(r) for r in errors.collect()]

    def delete_files(self, files: DataFrame) -> list[tuple[str, str]]:
        gone, errors = self._read(files)
        self._save(tables.delete(self.documents(), gone.where("format = 'Article'").select("doi", "type")))
        return [tuple(r) for r in errors.collect()]

    def add(self, folder: str) -> list[tuple[str, str]]:
        """Puts the files of a folder in."""
        return self.add_files(xml.files(self.spark, folder))

    def delete(self, folder: str) -> list[tuple[str, str]]:
        return self.delete_files(xml.files(self.spark, folder))

    def reprocess(self, tokens=latex_tokens) -> None:
        self._save(tables.reprocess(self.documents(), tokens))

    def convert(self) -> None:
        self._save(tables.rename_field(self.documents()))

    def check_years(self, years: DataFrame) -> list[tuple[str, str]]:
        """Takes over other years; gives the documents whose year was changed or is missing."""
        found = tables.check_years(self.documents(), years)
        self._save(found.drop("year_status"))
        return [tuple(r) for r in found.where("year_status <> 'same'").select("doi", "year_status").collect()]

    def update(self) -> None:
        """The index of the documents as they are: equations, metadata, and postings of short runs of tokens."""
        docs = self.documents()
        eqs = checkpointed(search.equations(tables.equation_rows(docs).withColumnRenamed("tokens", "t"), F.col("t")).drop("t"))
        runs = postings.postings(eqs, KEYS)
        snapshot.save({"equations": eqs, "metadata": tables.metadata(docs), "postings": runs}, self.index, write={"postings": postings.laid_out})

    def postings(self) -> DataFrame:
        return snapshot.load(self.spark, self.index, "postings")

    def equations(self) -> DataFrame:
        return snapshot.load(self.spark, self.index, "equations")

    def metadata(self) -> DataFrame:
        return snapshot.load(self.spark, self.index, "metadata")

    def get(self, doi: str | Column) -> DataFrame:
        """The stored document with a key."""
        return self.documents().where(F.col("doi") == doi)
