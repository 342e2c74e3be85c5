"""Kernels that run inside the JVM, for algorithms of one global order of steps that Python is too
slow for. The compiler that Spark uses for its own generated code builds the source on the driver,
and Spark hands the classes to the executors as an added jar."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

SOURCES = Path(__file__).resolve().parent.parent / "functions"


def register(spark: SparkSession, kernel: str, returns: DataType) -> str:
    """The SQL name of ``functions/<kernel>.java``, registered once a session."""
    name = f"voxelspark_{kernel.lower()}"
    if spark.catalog.functionExists(name):
        return name
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setTargetVersion(8)
    compiler.cook((SOURCES / f"{kernel}.java").read_text())
    classes = compiler.getBytecodes()
    folder = os.path.join(SparkFiles.getRootDirectory(), f"voxelspark-{uuid.uuid4().hex}")  # goes with the session
    os.makedirs(folder)
    jar = os.path.join(folder, f"{kernel}.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for c in classes:
            z.writestr(c.replace(".", "/") + ".class", bytes(classes[c]))
    spark.sql(f"ADD JAR '{jar}'")
    session = spark._jsparkSession
    made = session.sharedState().jarClassLoader().loadClass(f"voxelspark.{kernel}").newInstance()
    session.udf().register(name, made, session.parseDataType(returns.json()))
    return name
