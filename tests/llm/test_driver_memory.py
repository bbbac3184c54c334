"""The driver's memory between steps."""

import os
import subprocess
import sys

HELD = """
from brindle.llm.common import written
from brindle.session import session

spark = session("local[2]")
runtime = spark._jvm.java.lang.Runtime.getRuntime()
full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
held = spark._jvm.java.nio.ByteBuffer.allocate(300 << 20)
assert 2 * runtime.totalMemory() > runtime.maxMemory()
before = full()
out = written(spark.range(3), "few")
print("COLLECTED", full() > before)
assert sorted(r[0] for r in out.collect()) == [0, 1, 2]
"""


def test_a_written_step_has_a_grown_driver_heap_collected():
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 500m pyspark-shell", "PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", HELD], env=env, capture_output=True, text=True, timeout=120)
    assert "COLLECTED True" in out.stdout, out.stdout + out.stderr[-2000:]
