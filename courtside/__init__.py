"""courtside: league statistics as Spark DataFrame operators.

Every operator takes DataFrames (plus plain keyword parameters) and returns a
DataFrame; nothing is collected to the driver on the way.  Sub-packages:

* ``functions`` -- column expressions (text, numbers, game rules)
* ``sources``   -- table catalog, CSV and page readers, writers
* ``operators`` -- joins, aggregations, rankings, merges, resolution, reports
* ``plans``     -- the bindings and registered queries over the driver's tables
* ``streaming`` -- the incremental form of the page-to-facts upsert
"""

__version__ = "0.1.0"
