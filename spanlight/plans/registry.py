"""Extension points: framework detectors and test frameworks (V-1 to V-5, V-8, R-13)."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TEST_FRAMEWORKS
from ..operators import ast
from ..sources.manifest import has_axum


class FrameworkDetector(ABC):
    """What a web framework's detector answers; tables come from parsed sources."""

    name: str

    @abstractmethod
    def detect(self, project: str) -> bool: ...

    @abstractmethod
    def endpoints(self, parsed: DataFrame) -> DataFrame: ...

    @abstractmethod
    def routers(self, parsed: DataFrame) -> DataFrame: ...

    @abstractmethod
    def handlers(self, parsed: DataFrame) -> DataFrame: ...


class AxumDetector(FrameworkDetector):
    name = "axum"

    def detect(self, project: str) -> bool:
        return has_axum(project)

    def endpoints(self, parsed: DataFrame) -> DataFrame:
        return ast.web_routes(parsed)

    def routers(self, parsed: DataFrame) -> DataFrame:
        return ast.web_routers(parsed)

    def handlers(self, parsed: DataFrame) -> DataFrame:
        return ast.web_handlers(parsed)


class DetectorRegistry:
    def __init__(self):
        self.detectors: dict[str, FrameworkDetector] = {"axum": AxumDetector()}

    def add(self, detector: FrameworkDetector) -> None:
        self.detectors[detector.name] = detector

    def get(self, name: str) -> FrameworkDetector | None:
        return self.detectors.get(name)

    def detect(self, project: str) -> list[str]:
        return [n for n, d in self.detectors.items() if d.detect(project)]


def test_frameworks(spark: SparkSession) -> DataFrame:
    """framework, attributes, imports, supports_async, is_property_based (V-8, R-13)."""
    rows = spark.createDataFrame(TEST_FRAMEWORKS, "framework string, attributes array<string>, imports array<string>")
    return rows.withColumns({"supports_async": F.col("framework").isin("Tokio", "AsyncStd"), "is_property_based": F.col("framework") == "Proptest"})


TEST_RESULTS = "framework string, passed bigint, failed bigint, ignored bigint, duration_ms bigint"


class TestRunner(ABC):
    """What runs a framework's tests and reads their output (V-3)."""

    framework: str

    @abstractmethod
    def command(self) -> list[str]: ...

    @abstractmethod
    def results(self, spark: SparkSession, output: str) -> DataFrame: ...

    @abstractmethod
    def is_success(self, exit_code: int, output: str) -> bool: ...


class BuiltinRunner(TestRunner):
    """The language's own tests; output is not read, so all counts are 0 (V-3)."""

    framework = "BuiltIn"

    def command(self) -> list[str]:
        return ["cargo", "test"]

    def results(self, spark: SparkSession, output: str) -> DataFrame:
        return spark.createDataFrame([(self.framework, 0, 0, 0, 0)], TEST_RESULTS)

    def is_success(self, exit_code: int, output: str) -> bool:
        return exit_code == 0


def detected_test_frameworks(spark: SparkSession, project: str) -> DataFrame:
    """framework: always the built-in one (V-4)."""
    return spark.createDataFrame([(BuiltinRunner.framework,)], "framework string")
