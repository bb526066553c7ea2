import os
import subprocess
import sys

from tillroll.llm import shared

HELD = """
import os, numpy as np
from tillroll.llm import shared

def held():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

def run(batches):
    for x in batches:
        np.ones(30_000_000, np.uint8)                     # from here on arrays below this size come from the heap
        some = [np.ones(100_000, np.uint8) for _ in range(3000)]
        yield x
        kept.append(some.pop())                           # the heap can't shrink from its end
        del some

kept = []
first = held()
out = list(shared.released(run)([1, 2]) if WITH else run([1, 2]))
assert out == [1, 2], out
print(held() - first)
"""


def held(how: bool) -> float:
    done = subprocess.run([sys.executable, "-c", f"WITH = {how}" + HELD], capture_output=True, text=True, timeout=60,
                          cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert not done.returncode, done.stderr
    return float(done.stdout)


def test_a_worker_gives_back_what_it_does_not_use():
    assert held(True) < 60 < held(False)


def test_release_follows_a_failure_too(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))

    def run(batches):
        yield from batches
        raise ValueError
    got = shared.released(run)(iter([7]))
    assert next(got) == 7 and not calls
    try:
        next(got)
    except ValueError:
        pass
    assert calls == [1]
