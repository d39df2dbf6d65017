"""anchorline: longitudinal cohort analytics on Spark.

Every operator takes DataFrames and returns a lazy DataFrame.  People (or
accounts, devices, ...) are studied through their dated events around one
*index date* per person.

Sub-packages
------------
``sources``    tables in and out, code lists
``functions``  column expressions (dates, text, values) and closed-form statistics
``operators``  joins, selection, tabulation, reshaping
``plans``      cohort, phenotype, exposure, measurement, outcome, rate, survival and
               test plans, and the full care-home study built from them
``catalogue``  the same operators mapped onto the driver's tables, with oracle SQL
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with them, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
