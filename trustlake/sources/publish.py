"""Write-once documents: bytes under fixed keys, manifest last."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


class PublishError(RuntimeError):
    pass


@dataclass(frozen=True)
class PublishTarget:
    """A local root, or a URI that Hadoop's file systems know (s3a://, hdfs://)."""

    root: str
    spark: SparkSession | None = None

    def key(self, key: str) -> str:
        return f"{self.root.rstrip('/')}/{key.strip('/')}"


@dataclass(frozen=True)
class DocumentReceipt:
    key: str
    sha256: str
    size: int
    written: bool


def _read(target: PublishTarget, path: str) -> bytes | None:
    if "://" not in path:
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return f.read()
    jvm = target.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(target.spark._jsc.hadoopConfiguration())
    return bytes(target.spark.sparkContext.binaryFiles(path).first()[1]) if fs.exists(p) else None


def read_bytes(target: PublishTarget, key: str) -> bytes | None:
    """What stands under a key, or None."""
    return _read(target, target.key(key))


def _write(target: PublishTarget, path: str, data: bytes, overwrite: bool) -> None:
    if "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if overwrite:
            with open(f"{path}.tmp", "wb") as f:
                f.write(data)
            os.replace(f"{path}.tmp", path)
        else:
            with open(path, "xb") as f:
                f.write(data)
        return
    p = target.spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(target.spark._jsc.hadoopConfiguration()).create(p, overwrite)
    out.write(bytearray(data))
    out.close()


def publish_bytes(target: PublishTarget, key: str, data: bytes, *, overwrite: bool = False, idempotent: bool = False) -> DocumentReceipt:
    """An existing key is refused; ``overwrite`` replaces it, ``idempotent`` accepts the same bytes."""
    path, digest = target.key(key), hashlib.sha256(data).hexdigest()
    held = _read(target, path)
    if held is not None and not overwrite:
        if idempotent and held == data:
            return DocumentReceipt(key, digest, len(data), False)
        raise PublishError(f"{key} exists" + (" with other content" if idempotent else ""))
    try:
        _write(target, path, data, overwrite)
    except FileExistsError as e:
        raise PublishError(f"{key} exists") from e
    return DocumentReceipt(key, digest, len(data), True)


def publish_documents(target: PublishTarget, documents: dict[str, bytes], *, overwrite: bool = False, idempotent: bool = False, manifest_key: str = "manifest.json", extra: dict[str, Any] | None = None) -> list[DocumentReceipt]:
    """Documents in key order, then the manifest: who sees the manifest sees all of them."""
    if reserved := {"count", "files"} & set(extra or {}):
        raise PublishError(f"{sorted(reserved)} belong to the manifest itself")
    if manifest_key in documents:
        raise PublishError(f"{manifest_key} is the manifest's key")
    out = [publish_bytes(target, k, documents[k], overwrite=overwrite, idempotent=idempotent) for k in sorted(documents)]
    files = [{"key": r.key, "sha256": r.sha256, "size": r.size} for r in out]
    body = json.dumps({"count": len(files), "files": files, **(extra or {})}, indent=2, sort_keys=True).encode()
    return [*out, publish_bytes(target, manifest_key, body, overwrite=overwrite, idempotent=idempotent)]
