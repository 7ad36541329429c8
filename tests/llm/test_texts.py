import pyarrow as pa

from isobar.llm import texts


def test_a_task_gives_its_memory_back(monkeypatch):
    """The check of pipeline: workers kept what earlier stages had used."""
    calls = []
    monkeypatch.setattr(texts, "release", lambda: calls.append(1))

    def each(batches):
        for batch in batches:
            yield batch

    batch = pa.record_batch({"text": ["a"]})
    assert list(texts.releasing(each)(iter([batch, batch]))) == [batch, batch] and calls == [1]
    stopped = texts.releasing(each)(iter([batch, batch]))
    assert next(stopped) == batch
    stopped.close()
    assert calls == [1, 1]


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_released_memory_leaves_the_process():
    def each(batches):
        held = {i: (str(i), i) for i in range(1_000_000)}
        for batch in batches:
            yield batch.slice(0, len(held) and 1)

    before = _resident()
    list(texts.releasing(each)(iter([pa.record_batch({"text": ["a"]})])))
    assert _resident() - before < 60 << 20
