"""Behavioural anomaly analytics on access logs, as DataFrame -> DataFrame functions."""

import sys

from pyspark import cloudpickle

from watchframe.session import get_session

# the few Python helpers travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
