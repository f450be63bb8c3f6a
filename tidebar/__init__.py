"""tidebar: session analytics on bars, expressed as Spark DataFrame plans."""
