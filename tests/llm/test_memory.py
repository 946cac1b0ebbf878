"""Memory that tasks free goes back to the system."""

from __future__ import annotations

import sys

import psutil
import pytest

from colframe.llm import store


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="malloc_trim is the C library's of Linux")
def test_freed_memory_goes_back_when_a_task_ends():
    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(100_000)]  # smaller than what the C library maps apart
            last = [bytes(1000)]  # stays on top of what is freed below it
            del held
            kept.append(last)
            yield batch

    kept, own = [], psutil.Process()
    assert list(run([1])) == [1]
    before = own.memory_info().rss
    assert list(store.gives_back(run)([1, 2])) == [1, 2]
    assert before - own.memory_info().rss > 50 << 20


def test_memory_goes_back_after_an_error_too(monkeypatch):
    called = []
    monkeypatch.setattr(store, "_trim", lambda: called.append)

    def run(batches):
        yield from batches
        raise ValueError("a task's own error")

    with pytest.raises(ValueError, match="own error"):
        list(store.gives_back(run)([1]))
    assert called == [0]
