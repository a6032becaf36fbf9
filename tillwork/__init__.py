"""tillwork: recommendation data work as Spark DataFrame plans."""
