"""quillgrid: experiments on labelled text as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their task, so a cluster does not
# need the package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
