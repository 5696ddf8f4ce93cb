"""A frame's points as a table function: `spark.udtf.register("frame_points", FramePoints)`,
then `SELECT ... FROM frames, LATERAL frame_points(coordinates)`."""

from pyspark.sql.functions import udtf


@udtf(returnType="i: int, x: double, y: double")
class FramePoints:
    def eval(self, coordinates):
        """x and y in turn; a last one without a partner is left out."""
        if coordinates is not None:
            for k in range(len(coordinates) // 2):
                yield k, float(coordinates[2 * k]), float(coordinates[2 * k + 1])
