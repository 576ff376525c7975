"""Training-data operators: ten Spark jobs over documents and pages, each built
by one named method.  Nothing else in the library imports this subpackage."""
