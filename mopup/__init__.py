"""mopup: Spark-native profiling, quality scoring, cleaning and cleaning audit of tables.

Entry points: ``mopup.sources.readers.read_table``, ``mopup.operators.profile.profile``,
``mopup.operators.quality.components``, ``mopup.plans.clean.clean``.
"""

__version__ = "0.1.0"
