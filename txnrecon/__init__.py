"""Transaction ingestion and reconciliation over Spark DataFrames.

Sub-packages
------------
functions   Column -> Column scalars (text, dates, numbers, keys, answers)
sources     readers of loose input: mail, ledger JSON, rate JSON, config maps, labelled sets
operators   DataFrame -> DataFrame operators (gates, joins, windows, reconciliation)
plans       compositions of operators, the domain views and the query catalogue
streaming   Structured Streaming wrappers around the same operators
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions used inside tasks travel
# with the job instead of being imported by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
