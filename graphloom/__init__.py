"""graphloom: graph analytics and corpus preparation as PySpark DataFrame operators."""
