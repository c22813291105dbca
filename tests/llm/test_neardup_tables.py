"""What near duplicates leave on disk while they run."""

import os

from arcweave.llm import neardup


def test_bands_are_deleted_once_members_are_known(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 60 + i % 7))) for i in range(40)], "doc_id long, text string")
    tables, write, sets_of, banded = [], neardup.written, neardup.sets_of, []
    monkeypatch.setattr(neardup, "written", lambda df, name: (tables.append(write(df, name)), tables[-1])[1])

    def watched(*args):
        banded.extend(t for t in tables if "bands" in t.columns and os.path.exists(t._written_at.removeprefix("file://")))
        return sets_of(*args)

    monkeypatch.setattr(neardup, "sets_of", watched)
    found = neardup.groups(docs).collect()
    assert len(found) == 40 and any("bands" in t.columns for t in tables) and not banded
