"""spanpref: extraction-quality analytics and preference-data construction on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``DataFrame.transform``).  Column-level building blocks live in
``spanpref.functions``, readers/writers in ``spanpref.sources``, the
table operators in ``spanpref.operators``, named end-to-end queries in
``spanpref.plans`` and the streaming variant of confusion mining in
``spanpref.streaming``.
"""

__version__ = "0.1.0"
