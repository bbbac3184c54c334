"""Attachment metadata: states, reference counts of shared content, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AttachmentError
from ..sources.database import Collection, Database

FIELDS = "id string, parentCollection string, parentId string, filename string, fileType string, size bigint, contentHash string, uploadState string, deleteState string, retryCount int"
DELETE_STATES = ("none", "pending", "completed")
STATES = ("pending", "uploading", "completed", "failed")


class Attachments:
    def __init__(self, db: Database):
        self.db = db
        self.rows: Collection = db.collection("attachments", "id", FIELDS)

    def create(self, collection: str, parent_id: str, filename: str, content_hash: str, file_type: str = "", size: int = 0) -> dict:
        """The metadata of a file; one that exists is given back unchanged.  Its parent must exist."""
        key = f"{collection}:{parent_id}:{filename}"
        if old := self.rows.get(key):
            return old
        if self.db.collections[collection].get(parent_id) is None:
            raise AttachmentError(f"{collection} has no {parent_id}")
        row = {"id": key, "parentCollection": collection, "parentId": parent_id, "filename": filename, "fileType": file_type, "size": size, "contentHash": content_hash, "uploadState": "pending", "deleteState": "none", "retryCount": 0}
        self.rows.put(row)
        return row

    def set_state(self, key: str, state: str, reset_retry: bool = False) -> None:
        old = self.rows.get(key)
        if old is None or state not in STATES:
            raise AttachmentError(key if old is None else state)
        retries = 0 if reset_retry else old["retryCount"] + (state == "failed")
        self.rows.patch(key, {"uploadState": state, "retryCount": retries})

    def set_delete_state(self, key: str, state: str) -> None:
        """none, pending or completed: how far the deletion of the remote content is."""
        if self.rows.get(key) is None or state not in DELETE_STATES:
            raise AttachmentError(key if state in DELETE_STATES else state)
        self.rows.patch(key, {"deleteState": state})

    def query(self, **equal: object) -> DataFrame:
        return self.rows.where(equal).matching().orderBy("id")

    def pending(self) -> DataFrame:
        return self.query(uploadState="pending")

    def failed(self) -> DataFrame:
        return self.query(uploadState="failed").orderBy(F.desc("retryCount"), "id")

    def completed(self) -> DataFrame:
        return self.query(uploadState="completed")

    def blob_ref_count(self, content_hash: str) -> int:
        """How many attachments hold this content."""
        return self.rows.where({"contentHash": content_hash}).count()

    def has_blob(self, content_hash: str) -> bool:
        return self.blob_ref_count(content_hash) > 0

    def orphaned(self) -> DataFrame:
        from .relations import orphans

        out = None
        for (name,) in self.rows.frame().select("parentCollection").distinct().collect():
            part = orphans(self.query(parentCollection=name), "parentId", self.db.read(name), "_key")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.rows.frame()

    def ref_counts(self) -> DataFrame:
        return ref_counts(self.rows.frame(), "contentHash")

    def delete(self, key: str) -> bool:
        """Drop an attachment; whether its content is free now, as no other attachment holds it."""
        row = self.rows.get(key)
        if row is None:
            raise AttachmentError(key)
        self.rows.delete(key)
        return not self.has_blob(row["contentHash"])


def ref_counts(df: DataFrame, content: str) -> DataFrame:
    return df.where(F.col(content).isNotNull()).groupBy(content).agg(F.count(F.lit(1)).alias("refs"))
