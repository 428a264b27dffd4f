"""Content-derived identities."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import CORPUS_VERSION, GENERATION_VERSION

#: Ours; another tag gives other ids for the same chunks.
CHUNK_TAG = "tessera-chunk-v1"


def chunk_id(path: Column, start: Column, end: Column, language: Column, symbol: Column, text: Column, tag: str = CHUNK_TAG) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(tag), path, start.cast("string"), end.cast("string"), language, symbol, text), 256)


def _counted(value: Column) -> Column:
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def revision_head(policy: str) -> str:
    return "".join(f"{len(x.encode())}:{x}" for x in (CORPUS_VERSION, policy))


def corpus_revision(policy: str, ids: Column) -> Column:
    """Of an array of ids, in any order: each value after its length, ids sorted bytewise."""
    return F.sha2(F.concat(F.lit(revision_head(policy)), F.array_join(F.transform(F.sort_array(ids), _counted), "")), 256)


def revision_of(policy: str, ids: Iterable[str]) -> str:
    """The same from ids that come sorted, without holding them."""
    digest = hashlib.sha256(revision_head(policy).encode())
    for value in ids:
        digest.update(f"{len(value.encode())}:{value}".encode())
    return digest.hexdigest()


def framed(parts: Iterable[str | bytes]) -> str:
    """Digest of values, each after its length in 8 bytes."""
    digest = hashlib.sha256()
    for part in parts:
        raw = part.encode() if isinstance(part, str) else part
        digest.update(struct.pack(">Q", len(raw)) + raw)
    return digest.hexdigest()


def framed_column(parts: Iterable[Column]) -> Column:
    """``framed`` inside a plan."""
    pieces = []
    for part in parts:
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(part).cast("long")), 16, "0")), part.cast("binary")]
    return F.sha2(F.concat(*pieces), 256)


def generation_id(policy: str, revision: str, fingerprint: str | None = None) -> str:
    space = "semantic" if fingerprint else "lexical-only"
    return framed([GENERATION_VERSION, policy, revision, space, *([fingerprint] if fingerprint else [])])
