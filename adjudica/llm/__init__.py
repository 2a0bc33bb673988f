"""Operators of a training-data pipeline; nothing outside this subpackage imports them."""

from pyspark import cloudpickle

import adjudica

# Functions that run inside tasks travel with the job, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(adjudica)
