"""English stop words: Spark ML's default list, read from the Spark ML jar.

The analyzer this engine mirrors used another library's list, which is not
available here; Spark's own list is used instead (a parameter of A9/A10).
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile


@functools.lru_cache(maxsize=None)
def english() -> tuple[str, ...]:
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            raw = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
            return tuple(w for w in raw.split() if w)
    from pyspark.ml.feature import StopWordsRemover  # needs a running JVM
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
