"""ranktide: opportunity ranking for open-source packages, written as Spark jobs.

Layers, bottom-up:

* ``functions``  - Column expressions (scoring, semver, strings, dates, hashes).
* ``operators``  - DataFrame -> DataFrame building blocks (filters, windows,
  joins, aggregates, top-k, audits, keyed cache, line scans).
* ``sources``    - scans and sinks (landed Parquet, staging, JSON sources) and
  the bridge that derives the domain tables from the shared test tables.
* ``plans``      - the user-visible compositions (marts, pipeline, briefs,
  triage listing).
* ``streaming``  - interval-incremental staging as an ``availableNow`` stream.
"""

__version__ = "0.1.0"
