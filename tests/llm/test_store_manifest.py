"""Lost and altered recipes, and chunks that the index lacks."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colframe.llm import tokenstore

from .test_tokens import PATH


def files(store, name):
    return sorted(p for p in Path(store.folder.removeprefix("file://"), name).glob("*.parquet") if pq.read_metadata(p).num_rows)


def rewrite(path, change):
    table = change(pq.read_table(path))
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    pq.write_table(table, path)


@pytest.fixture
def store(spark, odd):
    return tokenstore.write_tokens(odd, PATH)


def both_raise(store):
    for read in (store.documents, store.checksums):
        with pytest.raises(Exception):  # noqa: B017
            read().collect()


def test_manifest_is_a_merkle_root(store):
    store.verify()
    [whole] = store.manifest.agg(F.sum("documents").alias("n")).collect()
    assert whole.n == store.recipes.count() and all(len(r.root) == 16 for r in store.manifest.collect())


def test_lost_recipes(store):
    rewrite(files(store, "recipes")[0], lambda t: t.slice(0, 0))
    both_raise(store)


def test_lost_recipe_file(store):
    lost = files(store, "recipes")[0]
    lost.with_name(f".{lost.name}.crc").unlink(missing_ok=True)
    lost.unlink()
    both_raise(store)


def test_altered_start(store):
    rewrite(files(store, "recipes")[0], lambda t: t.set_column(t.column_names.index("start"), t.schema.field("start"), [[x + 1 for x in t["start"].to_pylist()]]))
    both_raise(store)


def test_altered_chunks(store):
    def swapped(t):
        chunks = [c[::-1] if c[::-1] != c else c[:-1] for c in t["chunks"].to_pylist()]
        return t.set_column(t.column_names.index("chunks"), t.schema.field("chunks"), [chunks])

    rewrite(files(store, "recipes")[0], swapped)
    both_raise(store)


def test_chunk_missing_from_the_index(store):
    rewrite(files(store, "index")[0], lambda t: t.slice(1))
    both_raise(store)
