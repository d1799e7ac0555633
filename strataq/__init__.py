"""strataq: dependency, cryptography-inventory and corpus analytics on Spark DataFrames."""
