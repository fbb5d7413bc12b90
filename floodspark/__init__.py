"""floodspark: flood early-warning analytics as plain Spark DataFrame operators.

Sub-packages:

* ``sources``   - scans and sinks (station text files, archives, tables, JSON telemetry)
* ``functions`` - column-expression builders (parsing, calendar, physics, rules, device logic)
* ``operators`` - ``DataFrame -> DataFrame`` operators (cleaning, row windows, joins, labels,
  profiles, scaling, metrics, neighbours, balancing, models, scenarios)
* ``plans``     - compositions of operators into jobs, and the binding to the test tables
* ``streaming`` - Structured Streaming jobs for device telemetry
"""

__version__ = "0.1.0"
