"""Report and data-card sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITATIONS, SCHEMA_VERSION
from ..operators.governance import clean_releases


def write_report(result, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Findings, evidence, summary and releases (metadata, hashes, limitations and
    schema version), each a folder under ``path``."""
    releases = (clean_releases(result.releases).join(result.hashes(), "release_id", "left")
                .withColumn("limitations", F.array(*[F.lit(x) for x in LIMITATIONS]))
                .withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    for name, df in (("findings", result.findings), ("evidence", result.evidence),
                     ("summary", result.summary), ("releases", releases)):
        df.write.mode(mode).format(fmt).save(f"{path}/{name}")


def write_cards(cards: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Markdown card per release, in a folder named after the release and
    the card file."""
    (cards.select("release_id", "file_name", "markdown").write.mode(mode)
     .partitionBy("release_id", "file_name").text(path))
