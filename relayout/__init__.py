"""Move tables to a new layout on Spark and prove that nothing was lost.

``functions``  column expressions: canonical values, fingerprints, naming, layout rules
``sources``    catalogue, file, plan and evidence readers and writers
``operators``  DataFrame operators: comparison, classification, assessment, gates,
               rewrites, compaction, publication
``plans``      the jobs a user calls: inventory, assess, validate, migrate, run, optimize
"""

__version__ = "0.1.0"
