"""dependra: cooccurrence analytics over dependency-annotated corpora, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel by value, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
