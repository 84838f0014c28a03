"""dealscope: Spark-native cleaning and analytics for sales-pipeline and
work-order board exports.  Every operator is a lazy DataFrame -> DataFrame
function built from Spark SQL expressions."""

__version__ = "0.1.0"
