"""fleetlens: audit analytics over a whole fleet of source repositories, on Spark.

The unit of work is one ``files(repo, path, content)`` table holding many repositories.
Every operator is a DataFrame-to-DataFrame function keyed by ``repo``.
"""

__version__ = "0.1.0"
