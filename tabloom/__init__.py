"""tabloom: tabular synthesis, augmentation and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tabloom.spec import TableSpec

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["TableSpec"]
