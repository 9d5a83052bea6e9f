import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def bench(tmp_path):
    """Two domains; one lone file, one lone gold, one file that can't be read."""
    for domain, wrap in (("law/lease", True), ("sea/crew", False)):
        at = tmp_path / domain
        (at / "pdf+gold").mkdir(parents=True)
        schema = {"type": "object", "properties": {"t": {"type": "string"}}}
        (at / f"{at.name}-schema.json").write_text(json.dumps({"schema_definition": schema} if wrap else schema))
        for stem, pdf, gold in (("a 1", b"a long enough text", {"t": "x"}), ("b", b"!broken", {"t": None}), ("c", b"short", {"t": "z"}), ("lone", b"a text alone", None), ("none", None, {"t": "y"})):
            if pdf is not None:
                (at / "pdf+gold" / f"{stem}.pdf").write_bytes(pdf)
            if gold is not None:
                (at / "pdf+gold" / f"{stem}.gold.json").write_text(json.dumps(gold))
    (tmp_path / "law" / "notes").mkdir()
    return tmp_path
