"""quern: a Spark-native engine for semantic search over source trees and text."""
