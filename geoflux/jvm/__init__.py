"""Builds and attaches the JVM kernels.

The kernels are thin Java wrappers over the geometry library that Spark itself
bundles. They are compiled once with the JDK's compiler against Spark's own
jars, added to the session, and shipped to the executors as a jar, so spatial
functions run inside Spark's JVMs without Python workers.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

SOURCES = Path(__file__).parent / "geoflux"


def build() -> Path:
    """The jar of the kernels; compiled unless this user has built the same sources before."""
    files = sorted(SOURCES.glob("*.java"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files) + pyspark.__version__.encode()).hexdigest()[:16]
    jar = Path(tempfile.gettempdir()) / f"geoflux-kernels-{os.getuid()}-{digest}.jar"
    if jar.exists():
        return jar
    javac = shutil.which("javac") or (os.path.join(os.environ["JAVA_HOME"], "bin", "javac") if "JAVA_HOME" in os.environ else None)
    if not javac:
        raise RuntimeError("spatial functions need a JDK: javac was not found on the PATH or in JAVA_HOME")
    with tempfile.TemporaryDirectory() as out:
        jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "*")
        subprocess.run([javac, "-nowarn", "-cp", jars, "--release", "17", "-d", out, *map(str, files)], check=True, capture_output=True, text=True)
        made = f"{jar}.{os.getpid()}"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(Path(out).rglob("*.class")):
                z.write(p, p.relative_to(out))
        os.replace(made, jar)
    return jar


_loaders: dict[str, object] = {}


def loader(spark: SparkSession):
    """A class loader that knows the kernels; the jar goes to the executors once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        jar = build()
        sc._jsc.addJar(str(jar))
        url = sc._jvm.java.io.File(str(jar)).toURI().toURL()
        shared = spark._jsparkSession.sharedState().jarClassLoader()
        shared.addURL(url)
        _loaders[sc.applicationId] = shared
    return _loaders[sc.applicationId]


def static(spark: SparkSession, name: str, method: str, args: list):
    """The result of a static method of the kernels, found by its name and number of arguments."""
    gw = spark.sparkContext._gateway
    values = gw.new_array(gw.jvm.java.lang.Object, len(args))
    for i, a in enumerate(args):
        values[i] = a
    for m in loader(spark).loadClass(name).getMethods():
        if m.getName() == method and m.getParameterCount() == len(args):
            return m.invoke(None, values)
    raise AttributeError(f"{name} has no method {method} of {len(args)} arguments")
