"""Collation analytics on Spark: agreement, families, trees and statistics of textual witnesses."""
