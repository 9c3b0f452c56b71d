"""How much of a pass's contexts leaves a task of op13 at once."""

import types

import numpy as np
import pyarrow as pa
import pytest

from stratus.llm import class_lm


@pytest.mark.parametrize("dense", [class_lm.DENSE, 0])
def test_contexts_leave_in_slices(monkeypatch, dense):
    monkeypatch.setattr(class_lm, "DENSE", dense)
    monkeypatch.setattr(class_lm, "SLICE", 7, raising=False)
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in r.integers(0, 40, 300)]
    texts = [" ".join(words[:100]), "", " ".join(words[100:]), "held out"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([False, False, False, True]), pa.array(texts)], ["doc_id", "held_out", "text"])
    monkeypatch.setattr(class_lm.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    coded = list(class_lm._coder(b"k")(iter([rows])))
    ids = np.sort(class_lm.digests(pa.array([w.encode() for w in dict.fromkeys(words)], pa.binary()), b"k"))
    core, classes = ids[::2], (np.arange(len(ids[::2])) % 5).astype(np.uint8)
    end = class_lm.digests(pa.array([class_lm.END], pa.binary()), b"k")[0]
    kind = dict(zip(core.tolist(), classes.tolist(), strict=True))
    for of_core in (True, False):
        want: dict[tuple, int] = {}
        for t in texts[:3]:
            seq = [end, *class_lm.digests(pa.array([w.encode() for w in t.split()], pa.binary()), b"k").tolist(), end]
            for x, y in zip(seq, seq[1:]):
                for own, k in ((y, kind.get(x, class_lm.CLASSES)), (x, class_lm.CLASSES + 1 + kind.get(y, class_lm.CLASSES))):
                    if (own in kind) == of_core and not (own == end and own is seq[0] and k > class_lm.CLASSES):
                        want[int(own), k] = want.get((int(own), k), 0) + 1
        got: dict[tuple, int] = {}
        for b in class_lm._contexts(of_core, types.SimpleNamespace(value=(core, classes)))(iter(coded)):
            assert b.num_rows <= 7
            for i, c in zip(b.column("id").to_pylist(), b.column("contexts").to_pylist(), strict=True):
                for k, n in np.frombuffer(c, class_lm._CONTEXT).tolist():
                    got[i, k] = got.get((i, k), 0) + n
        drop = lambda d: {x: n for x, n in d.items() if x[0] != int(end)}
        assert drop(got) == drop(want)
