"""Devices for models: what a session's executors offer, what a stage of inference asks for, and a refusal before any work.

A model on the wrong device is a trap: weights are fetched, loaded and run for hours on a processor that takes minutes for
a document. So ``auto`` without a device is an error on the driver, before a task starts; ``cpu`` is a choice and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession


class NoDevice(RuntimeError):
    """No executor offers the device that a model needs; nothing was loaded."""


def offered(spark: SparkSession, resource: str = "gpu") -> float:
    """How many of a resource each executor of the session has: as configured, or, in a local session, as the driver has."""
    conf = spark.sparkContext.getConf()
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = spark.sparkContext.resources.get(resource)
        return len(found.addresses) if found else 0
    return float(conf.get(f"spark.executor.resource.{resource}.amount", "0"))


@dataclass(frozen=True)
class Device:
    """What a model runs on: ``auto`` (the resource, or a refusal), ``cpu``, or a name such as ``cuda:0`` that is taken as it is.

    per_task: the part of the resource that a task holds; cores: the cores beside it. grow: executors may be asked for
    anew with the resource, as dynamic allocation does, so a session without it is no reason to refuse. per_executor and
    discovery are for those executors.
    """

    name: str = "auto"
    resource: str = "gpu"
    per_task: float = 1.0
    cores: int = 1
    grow: bool = False
    per_executor: int = 1
    discovery: str = ""

    def needed(self) -> bool:
        return self.name != "cpu"

    def checked(self, spark: SparkSession) -> None:
        """Raise NoDevice if ``auto`` finds no resource."""
        if self.name == "auto" and not self.grow and offered(spark, self.resource) < self.per_task:
            raise NoDevice(
                f"no executor offers {self.per_task:g} of {self.resource!r} and the device is 'auto'. The model was not loaded. "
                "Configure spark.executor.resource.*, let executors grow, or choose the device 'cpu' if its slowness is wanted."
            )

    def profile(self) -> ResourceProfile | None:
        """The stage's resource profile; none for ``cpu``, whose tasks need nothing of their own."""
        if not self.needed():
            return None
        task = TaskResourceRequests().cpus(self.cores).resource(self.resource, self.per_task)
        made = ResourceProfileBuilder().require(task)
        if self.grow:
            made = made.require(ExecutorResourceRequests().cores(max(self.cores, int(self.cores * self.per_executor / self.per_task))).resource(self.resource, self.per_executor, self.discovery))
        return made.build

    def of_stage(self, spark: SparkSession) -> ResourceProfile | None:
        """profile() where stages can be scheduled by it: not in one JVM, where a task has what the driver has."""
        return self.profile() if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") else None

    def in_task(self) -> str:
        """The name of the device inside a task: the address that Spark gave the task, if it gave one."""
        if self.name != "auto":
            return self.name
        context = TaskContext.get()
        held = context.resources().get(self.resource) if context else None
        return f"cuda:{held.addresses[0]}" if held and held.addresses else "cuda:0"


class _Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def peak(spark: SparkSession):
    """An accumulator that holds the largest value that any task has added, such as the memory of its device."""
    return spark.sparkContext.accumulator(0, _Most())
