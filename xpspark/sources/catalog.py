"""Documents and collections by address: fn:doc, fn:doc-available, fn:collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DynamicError


class Catalog:
    """``documents`` has ``doc_id, uri, collection``; ``nodes`` their nodes."""

    def __init__(self, documents: DataFrame, nodes: DataFrame, default: str | None = None):
        self.documents, self.nodes, self.default = documents, nodes, default

    def of(self, documents: DataFrame) -> DataFrame:
        return self.nodes.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")

    def known(self, uri: str | None, collection: bool = False) -> DataFrame:
        """The documents at an address, or of a collection; without a name those of the default one, or all."""
        if not collection:
            if not uri:
                raise DynamicError("FODC0005")
            return self.documents.where(F.col("uri") == uri)
        name = uri if uri is not None else self.default
        return self.documents if name is None else self.documents.where(F.col("collection") == name)

    def doc(self, uri: str) -> DataFrame:
        """The document's nodes; none if the address is unknown."""
        return self.of(self.known(uri))

    def doc_available(self, uris: DataFrame, column: str = "uri") -> DataFrame:
        """``uris`` with a boolean ``available``."""
        known = self.documents.select(F.col("uri").alias("__uri")).distinct().withColumn("__known", F.lit(True))
        return uris.join(known, F.col(column) == F.col("__uri"), "left").withColumn("available", F.coalesce("__known", F.lit(False))).drop("__uri", "__known")

    def collection(self, name: str | None = None) -> DataFrame:
        """Nodes of a collection, of the default one, or of all documents."""
        return self.of(self.known(name, True)) if (name if name is not None else self.default) is not None else self.nodes
