"""Workers outlive their tasks: what a task has freed goes back to the system when it ends."""

import subprocess
import sys

CODE = """
import pyarrow as pa
from prosegauge.llm.common import _in_slices, trimmed

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

def use(batches):
    for b in batches:
        parts = [bytes(100_000) + bytes([i % 7]) for i in range(2000)]
        pins.append(parts[-1])  # keeps the heap from shrinking at its end
        del parts
        yield b

pins = []
batch = pa.RecordBatch.from_pydict({"x": [1]})
before = resident()
list(_in_slices(iter([batch]), use, 10))
print(resident() - before)
next(use([batch]))
trimmed(lambda group: group)(batch)
print(resident() - before)
"""


def test_freed_memory_is_returned():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path), "PATH": "/usr/bin:/bin"})
    assert all(float(x) < 60 for x in out.stdout.split()) and len(out.stdout.split()) == 2


ENCODE = """
import random, threading, time
import pyarrow as pa
from prosegauge.llm.common import LibraryCodec, release, vocabulary_path

def own():
    size, shared = open("/proc/self/statm").read().split()[1:3]
    return (int(size) - int(shared)) * 4096 / 1e6

def watch():
    while going:
        top.append(own())
        time.sleep(0.001)

rng = random.Random(1)
texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60)) for _ in range(2500)])
codec = LibraryCodec(vocabulary_path(), 100_000)
list(codec.encode_each(texts.slice(0, 10)))
release()
before, top, going = own(), [], [1]
watcher = threading.Thread(target=watch)
watcher.start()
ids = list(codec.encode_each(texts))
going.clear()
watcher.join()
whole = codec.tokenizer.encode(texts[7].as_py(), add_special_tokens=False).ids
print(max(top) - before, ids[7].tolist() == whole)
"""


def test_encoding_many_new_words_stays_small():
    """150,000 new words at once: 102 MB when the library held the results of all of them, 73 MB in parts."""
    out = subprocess.run([sys.executable, "-c", ENCODE], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path), "PATH": "/usr/bin:/bin"})
    most, same = out.stdout.split()
    assert float(most) < 88 and same == "True"
