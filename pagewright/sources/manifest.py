"""Model manifests (key = value lines) and the files that they name."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "pagewright/model-manifest/v1"
MAX_BYTES, MAX_LINES = 64 * 1024, 2_048
#: The keys of a manifest.
PART = ("url", "revision", "sha256", "bytes", "input.name", "output.name")
KEYS = (
    "schema_version", "task", "family", "version", "format", "backend", "upstream.commit", "license.review",
    *(f"detector.{k}" for k in PART), *(f"recognizer.{k}" for k in PART), "dictionary.sha256", "dictionary.entries", "dictionary.appends_space",
)


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Manifest:
    fields: dict[str, str]

    @property
    def classes(self) -> int:
        """Dictionary entries, the blank, and the space if one is appended."""
        return int(self.fields["dictionary.entries"]) + 1 + (self.fields["dictionary.appends_space"] == "true")

    def artifacts(self) -> list[tuple[str, str, int | None]]:
        """(name, digest, size) of each file; a dictionary's size isn't stated."""
        return [(p, self.fields[f"{p}.sha256"], int(self.fields[f"{p}.bytes"])) for p in ("detector", "recognizer")] + [("dictionary", self.fields["dictionary.sha256"], None)]


def parse(text: str) -> Manifest:
    """Strict: unknown, missing, empty and repeated keys are errors, and so are digests that aren't 64 lower-case hex digits."""
    if len(text.encode()) > MAX_BYTES:
        raise ManifestError("manifest is too long")
    fields: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        if n > MAX_LINES:
            raise ManifestError("manifest has too many lines")
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, found, value = (p.strip() for p in line.partition("="))
        if not (key and found and value):
            raise ManifestError(f"line {n} is no key = value")
        if key in fields:
            raise ManifestError(f"{key} occurs twice")
        fields[key] = value
    if missing := [k for k in KEYS if k not in fields]:
        raise ManifestError(f"{missing[0]} is missing")
    if unknown := [k for k in fields if k not in KEYS]:
        raise ManifestError(f"{unknown[0]} is unknown")
    if fields["schema_version"] != SCHEMA:
        raise ManifestError(f"schema {fields['schema_version']}")
    for key, value in fields.items():
        if key.endswith(".sha256") and not re.fullmatch("[0-9a-f]{64}", value):
            raise ManifestError(f"{key} is no digest")
        if key.endswith((".bytes", ".entries")) and not (value.isdigit() and value.isascii() and int(value) > 0):
            raise ManifestError(f"{key} is no positive number")
        if key.endswith(".appends_space") and value not in ("true", "false"):
            raise ManifestError(f"{key} is neither true nor false")
    return Manifest(fields)


def check_directory(path: str) -> str:
    if not path or ".." in path.split("/"):
        raise ManifestError("model directory")
    return path


def resolve(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(name, fault) for every expected file that isn't as it should be: missing, size, digest. expected: name, sha256, bytes (null: any); files: name, length, content. The size is compared before the digest is made."""
    rows = expected.join(files.select("name", "length", "content"), "name", "left")
    size = F.col("bytes").isNotNull() & (F.col("bytes") != F.col("length"))
    fault = F.when(F.col("length").isNull(), "missing").when(size, "size").when(F.sha2("content", 256) != F.col("sha256"), "digest")
    return rows.select("name", fault.alias("fault")).where("fault IS NOT NULL")
